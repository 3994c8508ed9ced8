"""Deeply nested JSON records to related flat tables by Merkle subtree identities.

Every object, and every array that holds objects, is canonicalised and hashed bottom-up: its identity is the digest of its own plain
members and of its children's identities, whatever the order its members were written in. Identical subtrees are stored once in the
object table; every occurrence stays as a row of the bridge table with parent, member name and ordinal.

Defined results: bodies that are null, blank or no complete JSON give nothing (a byte order mark and white space around are allowed);
a repeated delivery counts once; of two members of one name the last holds; nesting beyond the parser's depth counts as no JSON.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraloom.runtime import broadcast_if_small, materialise

BRIDGE = "doc bigint, parent string, parent_hash binary, member string, ordinal int, path string, child_hash binary, content string"


def _no_constant(name: str):
    raise ValueError(name)


def parse(body: str | None):
    """(True, value) of a complete JSON text, else (False, None)."""
    if body is None:
        return False, None
    try:
        return True, json.loads(body.lstrip("﻿"), parse_constant=_no_constant)
    except (ValueError, RecursionError):
        return False, None


_dumps = json.JSONEncoder(sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode


def _step(name: str) -> str:
    return name.replace("~", "~0").replace("/", "~1")


def shred_value(value, embedded: frozenset[str] = frozenset()) -> list[tuple]:
    """Occurrences (parent path, parent hash, member, ordinal, path, hash, content) of one document, children before parents.

    ``content`` is the canonical JSON of the plain members. A text member named in ``embedded`` that is JSON itself is opened."""
    rows: list[tuple] = []

    def node(v, path: str) -> tuple[bytes, str] | None:
        """Identity and content of an object, or of an array that holds objects; nothing for an array that holds none."""
        plain, children, is_object = {}, [], isinstance(v, dict)
        for k, (name, x) in enumerate(v.items() if is_object else ((None, x) for x in v)):
            if embedded and isinstance(x, str) and name in embedded:
                ok, inner = parse(x)
                x = inner if ok and isinstance(inner, (dict, list)) else x
            if isinstance(x, (dict, list)):
                step = f"{path}/{_step(name) if is_object else k}"
                below = node(x, step)
                if below is not None:
                    children.append((name, None if is_object else k, step, *below))
                    continue
            plain[name if is_object else str(k)] = x
        if not is_object and not children and path:  # the whole document always has an identity
            return None
        content = _dumps(plain)
        h = hashlib.blake2b(digest_size=16)
        h.update(("{" if is_object else f"[{len(v)}").encode())
        h.update(content.encode("utf-8", "surrogatepass"))
        for name, k, _, digest, _ in sorted(children, key=lambda c: (c[0] or "", c[1] or 0)):
            h.update(_dumps([name, k]).encode("utf-8", "surrogatepass") + digest)
        identity = h.digest()
        rows.extend((path, identity, name, k, step, digest, inner) for name, k, step, digest, inner in children)
        return identity, content

    if isinstance(value, (dict, list)):
        try:
            whole = node(value, "")
        except RecursionError:
            return []
        if whole is not None:
            rows.append((None, None, None, None, "", *whole))
    return rows


def shred(df: DataFrame, key: str, body: str, embedded: frozenset[str] = frozenset()) -> DataFrame:
    """The occurrences of all documents, see BRIDGE; ``content`` rides along until :func:`tables` moves it to the object table."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc, text in zip(b["doc"], b["body"]):
                ok, value = parse(text if isinstance(text, str) else None)
                if ok:
                    rows += [(doc, *r) for r in shred_value(value, embedded)]
            out = pd.DataFrame(rows, columns=["doc", "parent", "parent_hash", "member", "ordinal", "path", "child_hash", "content"])
            out["ordinal"] = out["ordinal"].astype("Int32")
            yield out

    texts = df.select(F.col(key).cast("bigint").alias("doc"), F.col(body).alias("body")).filter("doc is not null and body is not null")
    return texts.distinct().mapInPandas(run, BRIDGE)


def tables(occurrences: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(objects, bridge): each distinct subtree once, and every occurrence once for each document."""
    objects = occurrences.groupBy(F.col("child_hash").alias("hash")).agg(F.min("content").alias("content"), F.count("*").alias("occurrences"))
    bridge = occurrences.groupBy("doc", "path").agg(F.min(F.struct("child_hash", "parent_hash", "parent", "member", "ordinal")).alias("r"))
    return objects, bridge.select("doc", "r.parent", "r.parent_hash", "r.member", "r.ordinal", "path", "r.child_hash")


#: Occurrences of one object above which it is kept in several copies for joins, each for a part of them.
HOT = 100_000


def with_content(occurrences: DataFrame, hot: int = HOT) -> DataFrame:
    """Occurrences (child_hash, …) with their object's content, joined by the hash; an object that a third of all documents share is joined in parts."""
    objects = materialise(occurrences.groupBy("child_hash").agg(F.min("content").alias("content"), F.ceil(F.count("*") / hot).cast("int").alias("_parts")))
    shared = objects.filter("_parts > 1").select("child_hash", "_parts")  # at most rows / HOT
    bridge = occurrences.drop("content")
    if shared.isEmpty():
        return bridge.join(objects.drop("_parts"), "child_hash")
    bridge = bridge.join(broadcast_if_small(shared), "child_hash", "left").withColumn("_part", F.pmod(F.xxhash64("doc", "path"), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
    objects = objects.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    return bridge.join(objects, ["child_hash", "_part"]).drop("_part")


def graph_features(occurrences: DataFrame) -> DataFrame:
    """Rows (graph_id, node_id, feature_idx, model_id) of measurement graphs, from objects and the bridge of their occurrences.

    Nodes are the members of ``nodes`` (a map by id, or a list of objects with ``id``), at the top or under ``graph``; features a list, or
    one object; a model an object with ``id`` or the id itself. Only nodes and models need their objects; features are places in the bridge."""
    occurrences = materialise(occurrences.drop("parent_hash"))
    under = F.regexp_extract("parent", r"^((?:/graph)?/nodes/[^/]*)$", 1)
    of_list = F.regexp_extract("parent", r"^((?:/graph)?/nodes/[^/]*)/features$", 1)
    text = lambda c, name: F.get_json_object(c, f"$.{name}")
    is_node, is_model = F.col("parent").isin("/nodes", "/graph/nodes"), (F.col("member") == "model") & (under != "")
    held = materialise(with_content(occurrences.filter(is_node | is_model)))
    nodes = held.filter(is_node).select("doc", F.col("path").alias("node"), F.coalesce("member", text("content", "id")).alias("node_id"), text("content", "model").alias("model_ref"))
    models = held.filter(is_model).select("doc", F.col("parent").alias("node"), text("content", "id").alias("model_obj"))
    # A features member that is an array has the array's content, whose places are numbers; a lone feature is an object.
    listed = occurrences.filter((of_list != "") & F.col("ordinal").isNotNull()).select("doc", of_list.alias("node"), F.col("ordinal").alias("feature_idx"))
    lone = occurrences.filter((F.col("member") == "features") & (under != "")).select("doc", F.col("parent").alias("node"), F.lit(0).alias("feature_idx"))
    single = lone.join(listed.select("doc", "node").distinct(), ["doc", "node"], "left_anti")
    model = F.coalesce(F.expr("try_cast(model_obj as bigint)"), F.expr("try_cast(model_ref as bigint)"), F.lit(-1).cast("bigint"))
    known = nodes.join(models, ["doc", "node"], "left").filter("node_id is not null").groupBy("doc", "node", "node_id").agg(F.max(model).alias("model_id"))
    out = listed.unionByName(single).join(known, ["doc", "node"])
    return out.groupBy(F.col("doc").alias("graph_id"), "node_id", "feature_idx").agg(F.max("model_id").alias("model_id"))
