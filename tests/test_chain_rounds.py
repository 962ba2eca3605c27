"""Chains of pages are followed by numbers."""

import random

from areascope.sources import pages as PG


def test_rounds_of_chains_move_numbers_only(spark, monkeypatch):
    """Random links with gaps, copies and circles against a plain walk; no address goes through a round."""
    rnd, types = random.Random(3), []
    kept = PG.store
    monkeypatch.setattr(PG, "store", lambda df, *a, **k: types.append({t for _, t in df.dtypes}) or kept(df, *a, **k))
    links = {f"p{i}": rnd.choice([None, f"p{i + 1}", f"p{i + 1}", f"p{i + 1}", f"p{rnd.randrange(140)}"]) for i in range(120) if rnd.random() < 0.95}
    rows = [*links.items(), *rnd.sample(list(links.items()), 20), (None, "p1")]
    heads = [(f"r{i}", f"p{i}") for i in range(0, 140, 3)] + [("again", "p0"), ("null", None)]
    out = PG.follow_chains(spark.createDataFrame(heads, "request string, first_url string"), spark.createDataFrame(rows, "url string, next string"))

    def walk(at):
        seen = set()
        while at in links:
            if at in seen:
                return None, False, None
            seen.add(at)
            if links[at] is None:
                return len(seen), True, None
            at = links[at]
        return len(seen), False, at

    assert {r.request: (r.pages_reached, r.complete, r.missing) for r in out.collect()} == {r: walk(p) for r, p in heads}
    assert types and all(t <= {"bigint"} for t in types)
