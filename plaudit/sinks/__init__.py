"""Writers: CSV parts, review text folders, term triples, dictionaries."""
