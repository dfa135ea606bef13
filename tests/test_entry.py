"""The driver's contract: names agree, every query can be planned, nothing needs a session to import."""

import os
import subprocess
import sys

import __spark_entry__ as entry
import duckdb
from conftest import ROOT

SF = "/root/testdata/sf0.001"


def test_names_and_imports():
    known = entry.queries()
    assert set(entry.oracle_sql()) <= set(known) and len(known) >= 165
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()))"], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0 and int(out.stdout) == len(known)


def test_entry(spark):
    got = entry.entry(spark)
    assert got.columns == ["c", "n"] and got.count() == 150


HEAVY = ("ancestor_closure", "path_plus_closure", "components", "scc_cycles", "reachable_nodes")
#: Queries that take little time, held against DuckDB here; the driver compares all.
COMPARED = (
    "local_name_forms", "file_formats", "parsed_files", "folder_hash", "normalized_labels", "grounded_forms", "declared_individuals", "structured_roles", "evidence_windows", "grounding_chunks", "recovery_windows", "schema_replies",
    "individual_replies", "guarded_classes", "clean_schema", "verified_roles", "verified_classes", "accepted_links", "attached_parents",
    "scan_literals", "scan_blank_subject", "insert_union", "remove_difference", "merged_layers", "nquads_round_trip", "export_manifest", "relocate_iris", "add_classes", "add_axioms", "delete_axioms", "delete_nodes", "subordinate_properties",
    "list_walk", "collect_garbage", "split_import", "merge_duplicates", "replace_chunks", "delete_documents", "select_documents", "conflict_evidence", "routed_advice", "compound_labels", "property_view", "class_neighbourhood", "concept_filters",
    "sync_entities", "missing_aliases", "decide_queue", "popular_parents", "schema_delta", "merge_individuals", "optional_left", "delete_class_cascade", "quality_gate",
    "evidence_texts", "label_mentions", "first_mentions", "join_unbound", "optional_unbound", "minus_unbound", "not_exists_unbound", "closure_after_edits", "display_forest", "display_tree", "edited_individuals", "deleted_concepts",
    "broader_cycles", "subclass_cycle_conflicts", "concepts_per_scheme", "merged_duplicates_flow", "typed_sums", "typed_arithmetic", "missing_broader",
)


def test_light_queries_plan(spark):
    for name, f in entry.queries().items():
        if f.__wrapped__.__module__ == "graphloom.plans.registry" and name not in HEAVY:
            assert f(spark, SF).columns, name


def test_queries_against_sql(spark):
    db = duckdb.connect()
    for file in os.listdir(SF):
        db.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{file}')")
    shown = lambda v: f"{v:.6g}" if isinstance(v, float) else str(v)
    known, sql = entry.queries(), entry.oracle_sql()
    for name in COMPARED:
        got, want = known[name](spark, SF), db.execute(sql[name])
        names = [d[0] for d in want.description]
        assert sorted(names) == sorted(got.columns), name
        assert sorted([shown(r[c]) for c in names] for r in got.collect()) == sorted([shown(v) for v in r] for r in want.fetchall()), name
