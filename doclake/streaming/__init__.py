"""Optional streaming faces over append-only logs (an extension; batch forms are in ``operators``)."""
