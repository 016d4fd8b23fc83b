"""Player marts kept load by load equal the full recomputation, whatever comes late."""

import os
import random

import pytest

from matchmart.plans import incremental, marts

MATCHES = "match_id long, duration long, first_blood_time long, radiant_win boolean, region long"
PLAYERS = ("match_id long, player_slot int, steam_id long, personaname string, hero_id long, "
           "is_radiant boolean, win boolean")
STAT = ("match_id long, player_slot int, kills int, deaths int, assists int, denies int, last_hits int, "
        "gold_per_min int, xp_per_min int, hero_damage long, hero_healing long, tower_damage long")


def _rows(rng):
    m = [(i, rng.choice([None, 900, 1500, 2400, 3601]), rng.choice([None, 5, 77]), rng.choice([True, False, None]), 1)
         for i in range(12)]
    p = [(i, s, rng.choice([None, 7]), rng.choice([None, "a"]), 1, s < 3, rng.choice([True, False, None]))
         for i in range(13) for s in range(rng.randint(0, 4))]      # match 12 never comes
    s = [(r[0], r[1], *[rng.choice([None, rng.randint(0, 50)]) for _ in range(10)]) for r in p if rng.random() < 0.8]
    return {"matches": m, "players": p, "players_stat": s}


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_of_loads_equals_the_recomputation(spark, tmp_dir, seed):
    rng = random.Random(seed)
    rows, shapes = _rows(rng), {"matches": MATCHES, "players": PLAYERS, "players_stat": STAT}
    dealt = {n: [rng.randrange(3) for _ in r] for n, r in rows.items()}

    def frame(name, loads):
        return spark.createDataFrame([r for r, k in zip(rows[name], dealt[name]) if k in loads], shapes[name])

    for mart in incremental.FACT_STATES:
        root = os.path.join(tmp_dir, f"{mart}-{seed}")
        order = rng.sample(range(3), 3)
        for done, k in enumerate(order):
            before = {n: frame(n, order[:done]) for n in rows} if done else None
            for _ in range(2):                                       # the second is a replay
                incremental.add_load(spark, root, mart, before, {n: frame(n, [k]) for n in rows}, batch=str(k))
        want = getattr(marts, mart)(*[frame(n, [0, 1, 2]) for n in ("matches", "players", "players_stat")])
        got = incremental.mart_from_state(spark, root, mart)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
        assert incremental.current_state(spark, root, mart).where("n <= 0").count() == 0
