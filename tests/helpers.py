"""Small inputs made by hand or by a seed."""

import random

from pathloom.functions.payload import PAYLOAD

EVENT = "session_id string, timestamp long, event_id long, event_type string, pathname string, p struct<{}>".format(
    ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in PAYLOAD.fields)
)


def events(spark, rows, session="s"):
    """Rows (timestamp, event_type, payload dict, pathname) of one session."""
    out = []
    for i, row in enumerate(rows):
        ts, kind, payload, path = (*row, {}, None)[:4] if len(row) == 2 else (*row, None)[:4]
        p = {f.name: (payload or {}).get(f.name) for f in PAYLOAD.fields}
        out.append((session, ts, i, kind, path, p))
    return spark.createDataFrame(out, EVENT)


def skewed(seed=7, n=600, users=12):
    """(key, timestamp, event_id, name, value): key 0 owns about a third, times repeat, some names are null."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        key = 0 if r.random() < 0.35 else r.randrange(1, users)
        out.append((key, r.randrange(0, n * 3), i, r.choice(["a", "b", "c", None]), r.randrange(-3, 4)))
    return out


def by_key(rows):
    groups = {}
    for row in sorted(rows, key=lambda x: (x[0], x[1], x[2])):
        groups.setdefault(row[0], []).append(row)
    return groups
