"""Operators of a training-data pipeline; nothing else in the package imports this one.

Importing it registers the queries (``registry.QUERIES``) and their SQL (``registry.SQL``).
"""

import importlib
import pkgutil

for _module in sorted(m.name for m in pkgutil.iter_modules(__path__)):
    importlib.import_module(f"{__name__}.{_module}")
