"""Command-line tools over the library: ``python -m weftline.tools NAME ...``."""
