"""Training-data operators (WARC, search, token files, sharding, near-dedup,
packing, URL rules, quality).  Nothing outside this folder imports it."""
