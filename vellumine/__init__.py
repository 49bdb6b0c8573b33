"""A Spark engine for collections of Markdown documents with typed metadata."""
