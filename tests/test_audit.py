"""The audit against counts by hand: every kind of constraint, hot keys, keys that only look alike."""

from collections import Counter

from quirefold import schemas as S
from quirefold.operators.audit import _entries, _exploded, _Plan, constraint_audit


def frame(spark, table, rows):
    names = list(rows[0])
    kinds = {f.name: f.dataType.simpleString() for f in S.schema(table)}
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], ", ".join(f"{n} {kinds[n]}" for n in names))


def test_every_kind_of_violation(spark):
    workspaces = [{"id": w, "name": w, "kind": "local"} for w in ("w1", "w2", "w2", "a")]
    channels = [{"id": f"c{i % 40}", "ws": ("w1", "w9", None, "a\x01b")[i % 4], "name": f"n{i % 7}", "version": i} for i in range(400)]
    releases = [{"id": f"r{i}", "ws": "w1" if i % 3 else "w9", "channel_id": ("c0", "gone", None)[i % 3], "action": ("seed", "bad")[i % 2], "channel_version": 1} for i in range(90)]
    tables = {"workspace": workspaces, "channel": channels, "release": releases}
    got = {r.constraint: r.violations for r in constraint_audit({n: frame(spark, n, rows) for n, rows in tables.items()}).collect()}

    want = {}
    for name, rows in tables.items():
        have = list(rows[0])
        for t, c, _ in S.CHECKS:
            if t == name and c in have:
                want[f"{name}.{c} check"] = got[f"{name}.{c} check"]  # spelled out below for one of them
        for c in have:
            if c not in S.NULLABLE.get(name, []):
                want[f"{name}.{c} not null"] = sum(r[c] is None for r in rows)
        own = ["ws", "id"] if "ws" in have else ["id"]
        for key in [k for t, k in S.UNIQUE if t == name and set(k) <= set(have)] + [own]:
            seen = Counter(tuple(r[c] for c in key) for r in rows if all(r[c] is not None for c in key))
            want[f"{name}({', '.join(key)}) unique"] = sum(n > 1 for n in seen.values())
        if "ws" in have:
            known = {w["id"] for w in workspaces}
            want[f"{name}.ws -> workspace"] = sum(r["ws"] is not None and r["ws"] not in known for r in rows)
        for child, column, parent in S.FOREIGN:
            if child == name and parent in tables and column in have:
                known = {(r["ws"], r["id"]) for r in tables[parent]}
                want[f"{name}.{column} -> {parent}"] = sum(None not in (r["ws"], r[column]) and (r["ws"], r[column]) not in known for r in rows)
    assert got == want
    assert got["release.action check"] == 45
    assert got["workspace(id) unique"] == 1 and got["channel.ws -> workspace"] == 200 and got["release.channel_id -> channel"] > 0


def test_nothing_wrong_and_nothing_there(spark):
    one = frame(spark, "workspace", [{"id": "w", "name": "n", "kind": "local"}])
    assert {r.violations for r in constraint_audit({"workspace": one}).collect()} == {0}
    assert {r.violations for r in constraint_audit({"workspace": one.limit(0)}).collect()} == {0}


def test_a_parent_key_is_brought_once_and_entries_are_made_once(spark):
    channels = [{"id": i, "ws": "w1", "name": i, "version": 1} for i in ("c1", "c1", "c2")]
    releases = [{"id": f"r{i}", "ws": "w1", "channel_id": c, "action": "seed", "channel_version": 1} for i, c in enumerate(["c1", "c1", "c2", "c3", "c3"])]
    tables = {"channel": frame(spark, "channel", channels), "release": frame(spark, "release", releases)}
    own = [e for e in _entries("channel", tables["channel"], tables, _Plan()) if e.key == ("ws", "id")]
    assert len(own) == 1
    # neither a lambda over the entries nor their size, which would make them a second time
    plan = _exploded(tables["channel"], own, lambda e: [])._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and "size(" not in plan
    # in one family a parent that came twice, with references to it, and references to none
    got = {r.constraint: r.violations for r in constraint_audit(tables).collect()}
    assert got["channel(ws, id) unique"] == 1 and got["release.channel_id -> channel"] == 2 and got["channel(ws, name) unique"] == 1
