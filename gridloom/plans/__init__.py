"""Plans over the store: access-filtered traversal and question answering."""
