from __future__ import annotations

import public_tokenizers

from doclake.llm import byte_bpe, near_dedup, worker


def test_a_claim_lets_go_of_what_others_keep():
    mine, other = {1: 1}, {2: 2}
    worker.keep("mine", mine.clear)
    worker.keep("other", other.clear)
    worker.claim("mine")
    assert mine == {1: 1} and other == {}
    worker.claim("third")
    assert mine == {}


def test_groups_of_texts_hash_alike(monkeypatch):
    texts = ["a b c d e f", None, "", "x " * 500, "b c d e f g", "one", "a b c d e f"] * 3
    want = near_dedup.shingle_sets(texts, 5)
    monkeypatch.setattr(near_dedup, "GROUP_BYTES", 8)
    got = near_dedup.shingle_sets(texts, 5)
    assert [s.tolist() for s in got] == [s.tolist() for s in want] and len(got) == len(texts)


def test_ids_do_not_depend_on_what_is_kept():
    texts = [f"word{i} and tail{i % 7}" for i in range(200)]
    coder = byte_bpe.Codec(public_tokenizers.path(byte_bpe.RANKS), public_tokenizers.PATTERN)
    want = coder.encode(texts)
    coder.most = 10
    got = [ids for i in range(0, 200, 20) for ids in coder.encode(texts[i : i + 20])]
    assert got == want and coder.decode(got) == [t.encode() for t in texts]


def test_slices_hold_every_text_in_order():
    texts = ["ab", None, "x" * 50, "", "c", "dd" * 3, None]
    got = list(byte_bpe.slices(texts, 5))
    assert [t for part in got for t in part] == texts and all(len(p) == 1 or sum(len(t or "") for t in p) <= 5 for p in got)
    assert list(byte_bpe.slices([], 5)) == []
