"""Tables, their stores and file formats."""
