"""evidentia: evidence analytics for question answering, expressed as Spark plans."""

__version__ = "0.1.0"
