"""Queries of the training-data operators, over whole tables, with the operators' own parameters."""

from __future__ import annotations

from graphloom.llm import canonical, components, dedup, neighbours, overlap, packing, pieces, tokens
from graphloom.storage import table


def p1_found(spark, d):
    return overlap.found(table(spark, d, "canonical_interaction"))


def p1_report(spark, d):
    return overlap.report(table(spark, d, "canonical_interaction"))


def p3_found(spark, d):
    return neighbours.found(table(spark, d, "node_features"))


def p3_nearest(spark, d):
    return neighbours.nearest(table(spark, d, "node_features"))


def p4_found(spark, d):
    return dedup.found(table(spark, d, "canonical_interaction"))


def p4_collapsed(spark, d):
    return dedup.collapsed(table(spark, d, "canonical_interaction"))


def p6_found(spark, d):
    return components.entity_groups(table(spark, d, "canonical_interaction"))


def p6_splits(spark, d):
    return components.assign_splits(table(spark, d, "canonical_interaction"))


def p7_found(spark, d):
    return canonical.found(table(spark, d, "brenda"), table(spark, d, "ref_ligand"))


def p7_unmatched(spark, d):
    return canonical.unmatched(table(spark, d, "brenda"), table(spark, d, "ref_ligand"))


def p8_ids(spark, d):
    return tokens.encode(table(spark, d, "documents"))


def p9_containers(spark, d):
    return packing.pack(table(spark, d, "documents"))


def p9_tiers(spark, d):
    return packing.tier_report(packing.pack(table(spark, d, "documents")))


def p10_found(spark, d):
    return pieces.found(table(spark, d, "documents"))


def p10_pieces(spark, d):
    return pieces.pieces(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_report, p3_found, p3_nearest, p4_found, p4_collapsed, p6_found, p6_splits, p7_found, p7_unmatched, p8_ids, p9_containers, p9_tiers, p10_found, p10_pieces)}
