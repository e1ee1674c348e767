"""Named queries with the SQL that states each of them."""
