"""Plans over whole tables: catalog queries, storage layout, encode and decode."""
