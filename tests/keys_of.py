"""Print the query keys of one plan module."""
import importlib
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from flowspark.plans.registry import QUERIES  # noqa: E402

importlib.import_module(f"flowspark.plans.{sys.argv[1]}")
print(" ".join(k for k, fn in QUERIES.items() if fn.__module__.endswith(sys.argv[1])))
