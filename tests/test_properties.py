"""Randomised checks against brute force: form decoding vs the standard
library, latest-wins and last-row vs pandas."""

import random
from datetime import datetime, timedelta
from urllib.parse import parse_qsl, quote_plus

import pandas as pd

from stationlake.functions.text import decode_form, with_form
from stationlake.operators.upsert import last_row, latest_wins

KEYS = ["PASSKEY", "tempf", "a b", "x=y", "k&z", "ümlaut", "dateutc"]
VALUES = ["", "1", "91.8", "2026-07-17 07:00:27", "a+b", "50%", "x=y", "naïve", "&", " "]


def random_body(rnd):
    parts = []
    for _ in range(rnd.randint(0, 8)):
        k, v = rnd.choice(KEYS), rnd.choice(VALUES)
        shape = rnd.random()
        if shape < 0.1:
            parts.append(quote_plus(k))                       # no '='
        elif shape < 0.15:
            parts.append("")                                  # empty pair
        else:
            parts.append(f"{quote_plus(k)}={quote_plus(v)}")
    return "&".join(parts)


def test_decode_matches_parse_qsl(spark):
    rnd = random.Random(11)
    bodies = sorted({random_body(rnd) for _ in range(400)})
    df = spark.createDataFrame([(b,) for b in bodies], "body string")
    for frame in (df.select("body", decode_form("body").alias("form")), with_form(df)):
        got = {r["body"]: dict(r["form"]) for r in frame.collect()}
        for b in bodies:
            assert got[b] == dict(parse_qsl(b, keep_blank_values=True)), b


def test_latest_wins_and_last_row_match_pandas(spark):
    rnd = random.Random(5)
    t0 = datetime(2024, 1, 1)
    rows = []
    for seq in range(3000):
        station = rnd.choice(["hot"] * 6 + ["a", "b", "c"])   # one station holds most rows
        rows.append((station, t0 + timedelta(minutes=rnd.randint(0, 300)), seq, rnd.random()))
    df = spark.createDataFrame(rows, "PASSKEY string, timestamp timestamp_ntz, seq long, v double").repartition(7)
    pdf = pd.DataFrame(rows, columns=["PASSKEY", "timestamp", "seq", "v"])

    want = pdf.sort_values("seq").groupby(["PASSKEY", "timestamp"]).tail(1)
    got = latest_wins(df).toPandas()
    key = ["PASSKEY", "timestamp"]
    assert (got.sort_values(key).reset_index(drop=True)[["seq", "v"]]
            .equals(want.sort_values(key).reset_index(drop=True)[["seq", "v"]]))

    want_last = pdf.sort_values(["timestamp", "seq"]).groupby("PASSKEY").tail(1)
    got_last = last_row(df).toPandas()
    assert (got_last.sort_values("PASSKEY").reset_index(drop=True)[["seq", "v"]]
            .equals(want_last.sort_values("PASSKEY").reset_index(drop=True)[["seq", "v"]]))


def _strptime_or_none(text):
    from datetime import datetime as dt
    try:
        return dt.strptime(text, "%Y-%m-%d %H:%M:%S")
    except ValueError:
        return None


def test_dateutc_matches_strptime(spark):
    from stationlake.functions.times import parse_dateutc

    rnd = random.Random(9)

    def part(lo, hi, pad):
        v = rnd.randint(lo, hi)
        return f"{v:02d}" if pad and rnd.random() < 0.7 else str(v)

    texts = set()
    for _ in range(600):
        year = rnd.choice(["2024", "2023", "1999", "24", "20245"])
        sep = rnd.choice([" ", " ", " ", "T", "  "])
        texts.add(f"{year}-{part(0, 13, True)}-{part(0, 32, True)}{sep}"
                  f"{part(0, 25, True)}:{part(0, 61, True)}:{part(0, 61, True)}")
    texts |= {"2024-02-29 12:00:00", "2023-02-29 12:00:00", "2024-12-31 23:59:59"}
    df = spark.createDataFrame([(t,) for t in sorted(texts)], "s string")
    got = {r["s"]: r["t"] for r in df.select("s", parse_dateutc("s").alias("t")).collect()}
    for text in texts:
        assert got[text] == _strptime_or_none(text), text
