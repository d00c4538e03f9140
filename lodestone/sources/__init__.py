"""Reading and writing of indexes, vectors and configurations."""
