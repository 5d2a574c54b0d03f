"""Print the registered queries of one plans module: python tools/names.py datasets."""
import os, sys
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from kinetable.plans import catalog, registry
print(" ".join(n for n, f in registry.QUERIES.items() if f.__module__.endswith("." + sys.argv[1])))
