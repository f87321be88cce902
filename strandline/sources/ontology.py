"""Vocabularies from YAML: classic trees, trees with negative examples, and the ``node:`` format, as one node table.

Full names join the path with ``/``; branch nodes end with ``/``; ``/`` and ``\\`` inside names are escaped.
"""

from __future__ import annotations

import yaml
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "node_path string, parent_path string, branch string, is_leaf boolean, polarity double, examples array<string>, neg_examples array<string>, patterns array<string>"


def escaped(name: str) -> str:
    return name.replace("\\", "\\\\").replace("/", "\\/")


def _list(value) -> list[str]:
    return [str(v) for v in (value if isinstance(value, list) else [value])] if value is not None else []


def _row(parent: str, fields: dict, leaf: bool, name: str) -> tuple:
    path = parent + escaped(name) + ("" if leaf else "/")
    parts = path.strip("/").split("/")
    examples = (_list(fields.get("examples")) + _list(fields.get("descriptions") or fields.get("description"))) or ([] if leaf else [name])
    return path, parent, parts[1] if len(parts) > 1 else parts[0], leaf, float(fields.get("polarity", 1) or 1), examples, _list(fields.get("neg_examples") or fields.get("negative_examples")), _list(fields.get("patterns") or fields.get("pattern"))


def nodes_of(tree) -> list[tuple]:
    """Rows of the node table of a parsed YAML tree in any of the dialects."""
    rows: list[tuple] = []

    def walk(item, parent: str) -> None:
        if isinstance(item, list):
            for x in item:
                walk(x, parent)
        elif isinstance(item, str):
            rows.append(_row(parent, {}, True, item))
        elif isinstance(item, dict):
            if "OntologyNode" in item or ("name" in item and "node" not in item):
                fields = {k: v for k, v in item.items() if k != "OntologyNode"} | (item["OntologyNode"] if isinstance(item.get("OntologyNode"), dict) else {})
                rows.append(_row(parent, fields, True, str(fields.get("name", ""))))
            elif isinstance(item.get("node"), dict):
                node = item["node"]
                children = node.get("children")
                rows.append(_row(parent, node, not children, str(node.get("name", ""))))
                if children:
                    walk(children, rows[-1][0])
            else:
                for name, children in item.items():
                    inner = next((c["InnerOntologyNode"] if isinstance(c.get("InnerOntologyNode"), dict) else c for c in children if isinstance(c, dict) and "InnerOntologyNode" in c), {}) if isinstance(children, list) else {}
                    rows.append(_row(parent, inner, False, str(name)))
                    walk([c for c in children if not (isinstance(c, dict) and "InnerOntologyNode" in c)] if isinstance(children, list) else children, rows[-1][0])

    walk(tree, "")
    return rows


def read_ontology(spark: SparkSession, text: str) -> DataFrame:
    """The node table of a YAML text; a vocabulary is small and is parsed on the driver."""
    return spark.createDataFrame(nodes_of(yaml.safe_load(text)), SCHEMA)
