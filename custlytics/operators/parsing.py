"""What runs in Python workers: functions and imports of one script.

The module is shipped with the tasks, so workers need no copy of this package.
"""

from __future__ import annotations

import ast
import sys
from collections.abc import Sequence

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def parsed(content: str) -> ast.Module | None:
    """The script's tree, or nothing if it is broken or nested too deeply to be read."""
    try:
        return ast.parse(content)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def functions_of(content: str) -> list[dict]:
    lines = content.split("\n")
    tree = parsed(content)
    if tree is None:
        return [{"function_name": None, "start_line": 1, "end_line": len(lines), "source": content}]
    return [
        {
            "function_name": node.name,
            "start_line": node.lineno,
            "end_line": node.end_lineno,
            "source": "\n".join(lines[node.lineno - 1 : node.end_lineno]),
        }
        for node in ast.walk(tree)
        if isinstance(node, ast.FunctionDef)
    ]


def _modules(node: ast.stmt) -> list[str]:
    if isinstance(node, ast.Import):
        return [alias.name for alias in node.names]
    return ["." * node.level + (node.module or "")]


def _kind(module: str, custom: Sequence[str]) -> str:
    top = module.split(".")[0]
    if not top or top in custom:
        return "custom_modules"
    return "standard_libs" if top in sys.stdlib_module_names else "third_party"


def imports_of(content: str, custom: Sequence[str]) -> list[dict]:
    tree = parsed(content)
    return [
        {"statement": ast.unparse(node), "module": module, "kind": _kind(module, custom)}
        for node in (ast.walk(tree) if tree else ())
        if isinstance(node, (ast.Import, ast.ImportFrom))
        for module in _modules(node)
    ]
