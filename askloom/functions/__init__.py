"""Column functions: text, URL and question/answer splitting expressions."""
