"""Write docs/QUERIES.md: every registered query with its SURVEY ids, oracle
kind and one-line description (from the builder's docstring or note)."""
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from twinlens.plans import catalog  # noqa: E402
from twinlens.plans.registry import REGISTRY  # noqa: E402


def ids(name: str) -> str:
    parts = [p for p in name.split("_") if re.fullmatch(r"[a-z]\d+[a-z]?", p)]
    return ", ".join(p.upper() for p in parts)


def describe(e) -> str:
    """The builder's docstring, else the docstring of the first library
    function it calls."""
    import inspect
    doc = (e.build.__doc__ or "").strip()
    if doc:
        return " ".join(doc.split("\n\n")[0].split())
    src = inspect.getsource(e.build)
    g = e.build.__globals__
    for m in re.finditer(r"([A-Za-z_][A-Za-z0-9_]*)\.([A-Za-z_][A-Za-z0-9_]*)\(", src):
        obj = g.get(m.group(1))
        f = getattr(obj, m.group(2), None) if obj is not None else None
        if f is not None and getattr(f, "__module__", "").startswith("twinlens") and f.__doc__:
            return " ".join(f.__doc__.strip().split("\n\n")[0].split())
    return e.note


def main():
    sql = catalog.oracle_sql()
    lines = ["# Registered queries", "",
             "Generated by `tools/catalog_doc.py`. `S` = DuckDB oracle SQL, `R` = rows-only check.", "",
             "| query | SURVEY ids | check | what it computes |", "|---|---|---|---|"]
    for name, e in sorted(REGISTRY.items()):
        doc = describe(e).replace("|", "/")
        lines.append(f"| `{name}` | {ids(name)} | {'S' if name in sql else 'R'} | {doc or ''} |")
    os.makedirs("docs", exist_ok=True)
    with open("docs/QUERIES.md", "w") as f:
        f.write("\n".join(lines) + "\n")
    print(len(REGISTRY), "queries,", len(sql), "with oracle SQL")


if __name__ == "__main__":
    main()
