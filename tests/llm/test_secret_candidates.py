"""Random strings that stand behind a name, in a path or in upper-case hex."""

from __future__ import annotations

import random

from tessella.llm import secrets


def test_candidates(spark, sf):
    draw = random.Random(3)
    url, hexed = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "0123456789ABCDEF"
    made = lambda letters, n: "".join(draw.choice(letters) for _ in range(n))
    texts, want = [], []
    for _ in range(25):
        for before, body, after in [
            ("set AUTH_KEY=", made(url, 40), " here"), ("private_key=", made(url, 48), "&x=1"), ("see ?sig=", made(url, 40) + "=", " end"),
            ("get reset-link/of_user/", made(url, 40) + "_" + made(url, 8), " now"), ("id ", made(hexed, 40), "."), ("the ", made(hexed, 64), " key"),
        ]:
            texts.append(before + body + after)
            want.append((len(before), len(before) + len(body)))
    plain = ["number 31415926535897932384626433832795 is", "a run_of/words-that_are/just-names_of/some-files_in/the-tree here", "A" * 40, "THE_NAME_OF_A_VALUE=another_name_of_the_value"]
    rows = [(10**6 + k, t) for k, t in enumerate(texts + plain)]
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id: [tuple(map(int, s.split(":")[1:])) for s in r.spans.split(",") if s.startswith("random")] for r in secrets.digests(docs).collect()}
    found = [w in got[10**6 + k] for k, w in enumerate(want)]
    each = [sum(found[k::6]) for k in range(6)]
    assert min(each) >= 23, each  # each test of randomness rejects a few random strings
    assert not any(got[10**6 + len(texts) + k] for k in range(len(plain)))
