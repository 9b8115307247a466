"""PDF files as tables: bytes to objects, pages, instructions, glyphs, and back."""
