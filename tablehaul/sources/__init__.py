"""Readers: dump text, DDL, folder listings, catalogs and finished-item lists."""
