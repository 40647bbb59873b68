"""Training-data operators (documents, pages, conversations). Nothing outside this subpackage imports it."""
