"""Queries of the core operators on messages, schemas and timestamps."""

from __future__ import annotations

from strandline.operators.messages import kept_rows, surplus_rows
from strandline.operators.schema_drift import changes, unify
from strandline.operators.timestamps import found_instants
from strandline.plans import instants
from strandline.session import table


def p4_found(spark, sf_dir):
    return surplus_rows(table(spark, sf_dir, "notices"), table(spark, sf_dir, "teams"))


def p4_kept(spark, sf_dir):
    return kept_rows(table(spark, sf_dir, "notices"), table(spark, sf_dir, "teams"))


def p5_found(spark, sf_dir):
    return changes(table(spark, sf_dir, "meta_files"))


def p5_unified(spark, sf_dir):
    return unify(table(spark, sf_dir, "meta_files"))


def p6_found(spark, sf_dir):
    return found_instants(table(spark, sf_dir, "notices"), table(spark, sf_dir, "cdr"), table(spark, sf_dir, "teams"))


QUERIES = {"p4_found": p4_found, "p4_kept": p4_kept, "p5_found": p5_found, "p5_unified": p5_unified, "p6_found": p6_found}
SQL: dict[str, str] = {"p4_found": instants.P4_FOUND, "p4_kept": instants.P4_KEPT, "p6_found": instants.P6}
