"""Few-shot examples of all profiles at once against one profile at a time."""

import random

import pytest

from lexforge.operators import search

ATTEMPT = "id long, success boolean, validation_is_valid boolean, quality double, question string, figure_type string, difficulty string, complexity_score double, rhea_passed int, qwen_passes int, gemini_passes int"


def rows(seed, n=120):
    rng = random.Random(seed)
    some = lambda *x: rng.choice(x)
    return [(i, some(True, True, False), some(True, True, None), some(70.0, 80.0, 85.5, 99.0), some("Why?", "why? ", "How many?", "Which?", "", None), some("a", "b", "", None), some("easy", "hardest", None), some(0.1, 0.2, 0.2, 0.5, 0.9, rng.random(), None), some(0, 1, None), some(0, 1, 2), some(0, 1)) for i in range(n)]


def one(attempts, reported, kind, level, x, limit):
    good = [r for r in attempts if r[1] and r[2] and r[3] >= 80 and r[4] and r[0] not in reported and (not kind or r[5] == kind) and (not level or r[6] == level)]
    if x > 0:
        good = [r for r in good if r[7] is not None]
    far = lambda r: abs(r[7] - x) if x > 0 else -r[3]
    tail = lambda r: (0, r[9], r[10], r[0]) if level == "hardest" else (-(r[8] or 0), r[9], -r[10], r[0])
    out, seen = [], set()
    for r in sorted(good, key=lambda r: (far(r), tail(r)))[: 2 * limit]:
        said = r[4].strip().lower()
        if said not in seen:
            seen.add(said)
            out.append(r[0])
    return out[:limit]


@pytest.mark.parametrize("seed,limit", [(1, 2), (2, 1), (3, 5)])
def test_all_profiles(spark, seed, limit):
    attempts, rng = rows(seed), random.Random(seed)
    reported = {3, 7, 20}
    profiles = [(i, rng.choice(["a", "b", "", None, "zzz"]), rng.choice(["easy", "hardest", "", None]), rng.choice([0.0, None, 0.15, 0.2, 1.0, 5.0, rng.random()])) for i in range(60)]
    got = {}
    for r in search.few_shot_all(spark.createDataFrame(attempts, ATTEMPT), spark.createDataFrame([(i,) for i in reported] + [(None,)], "generation_attempt_id long"), spark.createDataFrame(profiles, "id long, figure_type string, difficulty string, complexity double"), limit).collect():
        got.setdefault(r.id, []).append((r.rank, r.attempt_id))
    for i, kind, level, x in profiles:
        assert [a for _, a in sorted(got.get(i, []))] == one(attempts, reported, kind or "", level or "", x or 0, limit), (kind, level, x)
