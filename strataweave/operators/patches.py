"""Patches on proof states: each is checked against the state that the ones before left, and accepted ones change it.

The fold is sequential within an intent and holds one state; intents are independent. In batch, states and patches of an intent stand together, sorted, and
a task streams over them, so no intent's patches are gathered, however many it has. As a stream, the same function runs on keyed state.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: The frontier reasons that each type of patch may answer, the confidence from which a closed proof cannot be challenged, and the action that a challenge asks for.
ALIAS_REASONS = ("CONFIG_BINDING_MISSING", "HOST_ALIAS_UNRESOLVED", "PATH_ONLY_TARGET_UNRESOLVED")
METHOD_REASONS = ("METHOD_UNKNOWN", "PATH_TEMPLATE_UNKNOWN", "PROVIDER_ENDPOINT_NOT_FOUND")
CHALLENGED_BELOW, REOPEN = 0.65, "reopen_frontier"
METHODS = ("GET", "POST", "PUT", "DELETE", "PATCH")

RESULT = "intent_id long, seq long, patch_type string, verdict string, errors string, status string, reason string, provider_id string, method string, target_id string"
STATE = "intent_id, provider_id, method, confidence, open_reason, hints (array), candidates (array of providers), options (array of endpoint_id, provider_id, method)"
PATCH = "intent_id, seq, patch_type, method, path, endpoint_id, service_id, host, alias_key, alias_value, action, reasons (array)"


def matches(state: dict) -> list[str]:
    """The endpoints that fit the state's provider and method."""
    return [o["endpoint_id"] for o in state["options"] or [] if o["provider_id"] == state["provider_id"] and state["method"] and o["method"] in (state["method"], "ANY")]


def evaluated(state: dict) -> tuple[str, str | None, str | None]:
    """Status, frontier reason and target of a state."""
    if state.get("challenged"):
        return "FRONTIER", "SMART_CONTRADICTION_CHALLENGED", None
    if not state["provider_id"]:
        return "FRONTIER", "PROVIDER_SERVICE_AMBIGUOUS" if len(state["candidates"] or []) > 1 else state["open_reason"], None
    if not state["method"]:
        return "FRONTIER", "METHOD_UNKNOWN", None
    found = matches(state)
    if state.get("hint") in found:
        found = [state["hint"]]
    if not found:
        return "FRONTIER", "PROVIDER_ENDPOINT_NOT_FOUND", None
    return ("CLOSED_ATOMIC", None, found[0]) if len(found) == 1 else ("FRONTIER", "ENDPOINT_MATCH_AMBIGUOUS", None)


def _method(patch: dict) -> str | None:
    m = (patch.get("method") or "").upper()
    return m if m in METHODS else None


def missing(patch: dict) -> list[str]:
    """What a patch of its type must carry and does not."""
    kind, has = patch["patch_type"], patch.get
    if kind == "alias_binding":
        return [f"{c} is required" for c in ("alias_key", "alias_value") if not has(c)] + ([] if has("service_id") or has("host") else ["service_id or host is required"])
    if kind == "endpoint_disambiguation":
        return [] if has("endpoint_id") else ["endpoint_id is required"]
    if kind == "provider_service_selection":
        return [] if has("service_id") else ["service_id is required"]
    if kind == "method_path_hint":
        return ([] if _method(patch) else ["method is required"]) + ([] if has("path") else ["path is required"])
    if kind == "contradiction_challenge":
        return ([] if has("action") == REOPEN else ["action must reopen"]) + ([] if has("reasons") else ["reasons are required"])
    return ["unknown type"]


def contradictions(state: dict, patch: dict) -> list[str]:
    """What in a complete patch does not fit the state."""
    kind = patch["patch_type"]
    status, reason, _ = evaluated(state)
    if kind == "contradiction_challenge":
        if status != "CLOSED_ATOMIC":
            return ["proof is not closed"]
        return ["proof is too confident"] if state["confidence"] >= CHALLENGED_BELOW else []
    wanted = {"alias_binding": ALIAS_REASONS, "method_path_hint": METHOD_REASONS, "endpoint_disambiguation": ("ENDPOINT_MATCH_AMBIGUOUS",), "provider_service_selection": ("PROVIDER_SERVICE_AMBIGUOUS",)}[kind]
    if reason not in wanted:
        return ["frontier does not ask for it"]
    if kind == "alias_binding":
        keys = {h.strip().lower() for h in state["hints"] or []}
        return ["alias_key is no hint of the frontier"] if keys and patch["alias_key"].strip().lower() not in keys else []
    if kind == "provider_service_selection":
        return [] if patch["service_id"] in state["candidates"] else ["service is no candidate"]
    mine = [o for o in state["options"] or [] if o["provider_id"] == state["provider_id"]]
    if kind == "method_path_hint":
        if not state["provider_id"]:
            return ["no provider"]
        return [] if any(o["method"] == _method(patch) for o in mine) else ["no endpoint of the provider fits"]
    option = next((o for o in state["options"] or [] if o["endpoint_id"] == patch["endpoint_id"]), None)
    if option is None:
        return ["unknown endpoint"]
    errors = [] if option["provider_id"] == state["provider_id"] else ["endpoint of another provider"]
    errors += [] if option["endpoint_id"] in matches(state) else ["endpoint is no candidate"]
    return errors + (["method differs"] if _method(patch) and option["method"] != _method(patch) else [])


def applied(state: dict, patch: dict) -> tuple[dict, list[str]]:
    """The state after a patch, and why it was rejected."""
    errors = missing(patch) or contradictions(state, patch)
    if errors:
        return state, errors
    kind = patch["patch_type"]
    if kind in ("alias_binding", "provider_service_selection"):
        return state | {"provider_id": patch.get("service_id")}, []
    if kind == "method_path_hint":
        return state | {"method": _method(patch)}, []
    if kind == "endpoint_disambiguation":
        return state | {"hint": patch["endpoint_id"]}, []
    return state | {"challenged": True}, []


def _row(state: dict, patch: dict, errors: list[str]) -> tuple:
    status, reason, target = evaluated(state)
    return state["intent_id"], patch["seq"], patch["patch_type"], "REJECTED" if errors else "ACCEPTED", "; ".join(errors), status, reason, state["provider_id"], state["method"], target


def _keyed(rows: DataFrame, kind: int, seq) -> DataFrame:
    return rows.select("intent_id", F.lit(kind).alias("kind"), seq.alias("seq"), F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("body"))


def fold(states: DataFrame, patches: DataFrame, partitions: int | None = None) -> DataFrame:
    """A row a patch of a known intent: verdict, errors, and the state after it. Patches count by seq, then by what they say; repeated ones are judged again."""
    rows = _keyed(states, 0, F.lit(0).cast("long")).unionByName(_keyed(patches, 1, F.col("seq").cast("long")))
    n = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartition(n, "intent_id").sortWithinPartitions("intent_id", "kind", "seq", "body")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            out = []
            for intent, kind, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist()):
                if kind == 0:
                    state = json.loads(body)
                elif state is not None and state["intent_id"] == intent:
                    patch = json.loads(body)
                    state, errors = applied(state, patch)
                    out.append(_row(state, patch, errors))
            names = [c.split(" ")[0] for c in RESULT.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k < 2 else pa.string()) for k, c in enumerate(zip(*out))] if out else [pa.array([], pa.int64() if k < 2 else pa.string()) for k in range(10)], names)

    return ordered.mapInArrow(run, RESULT)


def fold_stream(states: DataFrame, patches: DataFrame) -> DataFrame:
    """The same over a stream of patches: the first patch of an intent brings its state, which is kept from then on."""
    first = states.select("intent_id", F.to_json(F.struct(*states.columns), {"ignoreNullFields": "false"}).alias("state"))
    # Merged: states pass through no driver, and rows are sorted before they carry one.
    rows = patches.select("intent_id", F.col("seq").cast("long").alias("seq"), F.to_json(F.struct(*patches.columns), {"ignoreNullFields": "false"}).alias("body")).join(first.hint("merge"), "intent_id")

    def run(key: tuple, frames: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        held, todo = kept.get[0] if kept.exists else None, []
        for f in frames:  # all rows of an intent bring the same state: one is held
            held = f["state"].iloc[0] if held is None and len(f) else held
            todo += zip(f["seq"], f["body"])
        state, out = json.loads(held), []
        for _, body in sorted(todo):
            patch = json.loads(body)
            state, errors = applied(state, patch)
            out.append(_row(state, patch, errors))
        kept.update((json.dumps(state),))
        yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in RESULT.split(", ")])

    return rows.groupBy("intent_id").applyInPandasWithState(run, RESULT, "state string", "append", GroupStateTimeout.NoTimeout)
