"""Tables and the fixtures derived from them."""
