import math
import random

from lakeseek.llm import percentiles as P


def test_corrected_states_of_one_day_count_twice(spark):
    """Rows equal in keys and ``row`` that differ only in values outside the bounds, or left out, stay two while narrowing."""
    rnd, rows = random.Random(8), []
    for g in range(40):
        for day in range(12):
            v = [round(rnd.uniform(1, 10), 2) for _ in range(40)]
            rows.append((g, day, v))
            if day % 2 == g % 2 or rnd.random() < 0.3:
                rows += [(g, day, [*v, None]), (g, day, [*v, 0.001]), (g, day, [*v, 1000.0])]
        rows.append(rows[-1])  # a whole copy counts once
    df = spark.createDataFrame(rows, "g int, day int, v array<double>")
    values = {}
    for g, _, v in {(g, day, tuple(v)) for g, day, v in rows}:
        values.setdefault(g, []).extend(x for x in v if x is not None)
    at = lambda v, q: sorted(v)[math.ceil(round(q * len(v), 9)) - 1]
    ratios = {g: at(v, 0.9) / at(v, 0.5) for g, v in values.items()}
    for factor in (sorted(ratios.values())[i] - 1e-6 for i in (10, 20, 30)):
        got = {r["g"] for r in P.ratio_exceeds(df, ["g"], "v", ["day"], 0.9, 0.5, factor, 40, k=16).collect()}
        assert got == {g for g, v in values.items() if at(v, 0.9) > factor * at(v, 0.5)}
