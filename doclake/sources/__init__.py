"""Where rows come from: file trees, page readers, provider records and the derived catalog."""
