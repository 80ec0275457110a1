"""DataFrame operators over blocks, pages, paragraphs, chapters and the library."""
