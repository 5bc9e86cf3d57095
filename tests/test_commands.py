"""Commands on stories against a walk that changes its tables one command at a time."""

import random

from feedloom.operators import commands as c


def walked(rows, candidates, served, saves, feedback, links):
    saves, links, outbox = {k: dict(v) for k, v in saves.items()}, list(links), []
    events = [dict(e) for e in feedback]
    base = max((e["id"] for e in feedback), default=0)
    for at, cand, command, tab, ts in sorted(rows):
        if cand not in candidates:
            continue
        key = candidates[cand]
        marked = key in saves or any(k == key for _, k in links) or any(e["axis"] == "saved" and e["url_key"] == key for e in events)
        if command == "unsave":
            if key in saves and (saves[key]["link_id"] or 0) > 0:
                outbox.append((at, saves[key]["link_id"], "delete"))
            saves.pop(key, None)
            events = [e for e in events if not (e["axis"] == "saved" and e["url_key"] == key)]
            links = [x for x in links if x[1] != key]
            continue
        section = {"promote": "curated", "explore": "broad", "archive": "archive"}.get(command) or tab or served.get(cand) or "curated"
        if not marked:
            saves[key] = {"candidate_id": cand, "link_id": None, "section": section, "created_at": ts}
            events.append({"id": base + 2 * at, "candidate_id": cand, "url_key": key, "axis": "saved", "value": "explicit", "section": section, "created_at": ts})
        elif command != "save" or (key in saves and saves[key]["section"] != section):
            if key in saves:
                saves[key]["section"] = section
                if (saves[key]["link_id"] or 0) > 0:
                    outbox.append((at, saves[key]["link_id"], "put"))
            for e in events:
                if e["axis"] == "saved" and e["url_key"] == key:
                    e["section"] = section
        if command == "explore":
            events.append({"id": base + 2 * at + 1, "candidate_id": cand, "url_key": key, "axis": "interest", "value": "down", "section": "curated", "created_at": ts})
    return saves, events, links, outbox


def test_tables_equal_the_walk(spark):
    r = random.Random(6)
    candidates = {i: f"k{i % 25}" for i in range(40)}
    served = {i: r.choice(["broad", "curated"]) for i in range(0, 40, 2)}
    saves = {f"k{i}": {"candidate_id": i, "link_id": r.choice([None, -1, 100 + i]), "section": "curated", "created_at": 0} for i in range(0, 25, 4)}
    feedback = [{"id": n, "candidate_id": s["candidate_id"], "url_key": k, "axis": "saved", "value": "explicit", "section": "curated", "created_at": 0} for n, (k, s) in enumerate(saves.items())]
    feedback += [{"id": 50 + i, "candidate_id": i, "url_key": candidates[i], "axis": "interest", "value": "up", "section": "curated", "created_at": 0} for i in range(9)]
    links = [(i, f"k{i % 25}") for i in range(3, 33, 5)]
    for size in (0, 12, 120):
        rows = [(i + 1, r.randint(0, 43), r.choice(["save", "promote", "explore", "archive", "unsave"]), r.choice([None, "broad", "curated"]), 10 + i) for i in range(size)]
        got = c.applied(
            spark.createDataFrame(rows, "id long, candidate_id long, command string, section string, created_at long"),
            spark.createDataFrame(list(candidates.items()), "candidate_id long, url_key string"),
            spark.createDataFrame(list(served.items()), "candidate_id long, section string"),
            spark.createDataFrame([(k, *v.values()) for k, v in saves.items()], "url_key string, candidate_id long, link_id long, section string, created_at long"),
            spark.createDataFrame([tuple(e.values()) for e in feedback], "id long, candidate_id long, url_key string, axis string, value string, section string, created_at long"),
            spark.createDataFrame(links, "link_id long, url_key string"),
        )
        want = walked(rows, candidates, served, saves, feedback, links)
        assert {r.url_key: (r.candidate_id, r.link_id, r.section, r.created_at) for r in got.saves.collect()} == {k: tuple(v.values()) for k, v in want[0].items()}
        assert sorted(map(tuple, got.feedback.collect())) == sorted(tuple(e.values()) for e in want[1])
        assert sorted(map(tuple, got.links.collect())) == sorted(want[2])
        assert sorted(map(tuple, got.outbox.collect())) == sorted(want[3])
