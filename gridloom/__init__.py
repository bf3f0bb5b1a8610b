"""gridloom: spatio-temporal panel analytics and record processing as lazy Spark plans."""

__version__ = "0.1.0"
