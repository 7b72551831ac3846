"""Small ledgers for tests, and an independent hash of their chains."""

import hashlib
import json

from ledgerlens.schemas import RAW_EVENTS, payload_view

GENESIS = "0" * 64


def canonical(value):
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def event(n, kind, payload, session="s1", tier="groundTruth", target=None, refs=None, ts=None, mono=None):
    return {
        "id": f"ev{n:03d}", "sessionId": session, "ts": ts or f"2026-03-01T10:{n // 60:02d}:{n % 60:02d}.000Z",
        "monotonicTs": n * 1000 if mono is None else mono, "source": "process", "signalTier": tier,
        "kind": kind, "actor": {"kind": "agent", "runtimeId": "tester"}, "payload": payload,
        "target": target, "snapshotRef": refs,
    }


def exit_(n, command, code, **more):
    session, tier = more.pop("session", "s1"), more.pop("tier", "groundTruth")
    return event(n, "process.exit", {"command": command, "exitCode": code, "cwd": "/p", **more}, session, tier)


def write(n, path, mtime=None, in_scope=True, before=None, after=None, **more):
    payload = {"path": path, **({"mtimeMs": mtime} if mtime is not None else {})}
    refs = {k: v for k, v in (("before", before), ("after", after)) if v} or None
    target = {"raw": path, "resolved": path, "kind": "file"}
    if in_scope is not None:
        target["inScope"] = in_scope
    return event(n, "file.write", payload, target=target, refs=refs, **more)


def seal(events):
    """Chain each session in list order, hashing with the standard library only."""
    tips, out = {}, []
    for e in events:
        seq, prev = tips.get(e["sessionId"], (0, GENESIS))
        body = {
            **{k: e[k] for k in ("id", "sessionId", "ts", "monotonicTs", "source", "signalTier", "kind",
                                 "actor", "payload", "target", "snapshotRef")},
            "effectClass": None, "blastRadius": None, "reversible": None, "taint": None,
            "missionId": None, "seq": seq + 1, "prevHash": prev,
        }
        hash_ = hashlib.sha256((prev + canonical(body)).encode()).hexdigest()
        out.append({**e, "seq": seq + 1, "prevHash": prev, "hash": hash_})
        tips[e["sessionId"]] = (seq + 1, hash_)
    return out


def raw(spark, events):
    js = lambda v: None if v is None else json.dumps(v)
    rows = [
        (e["id"], e["sessionId"], e["seq"], e["ts"], e["monotonicTs"], e["source"], e["signalTier"], e["kind"],
         js(e["actor"]), js(e["target"]), None, None, None, None, None, js(e["payload"]),
         js(e["snapshotRef"]), e["prevHash"], e["hash"]) for e in events
    ]
    return spark.createDataFrame(rows, RAW_EVENTS)


def view(spark, events):
    return payload_view(raw(spark, seal(events))).drop("_p")
