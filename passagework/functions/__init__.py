"""Column functions: characters, features of candidates, annotations."""
