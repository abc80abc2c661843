"""Tables kept in a layout that reports can use."""
