"""What the pipeline's language stage rejects."""

import zlib

import numpy as np

from cloakframe.llm import language_id


def test_the_stage_rejects_what_no_language_has_most_of(spark, monkeypatch):
    """The network's verdict decides, beside the rule on letters."""
    r = np.random.default_rng(5)
    texts = {"xx": lambda: " ".join("".join(r.choice(list("abcde"), 5)) for _ in range(30)), "yy": lambda: " ".join("".join(r.choice(list("vwxyz"), 5)) for _ in range(30)), "zz": lambda: " ".join("".join(r.choice(list("klmno"), 5)) for _ in range(30))}
    ids = [k for k in range(400) if zlib.crc32(str(k).encode()) % 3 != 1]
    rows = [(k, texts[lang := sorted(texts)[k % 3]](), lang, "clean") for k in ids]
    mixed = [(1000 + k, "".join(x() for x in texts.values()), None, "mixed") for k in range(30)]
    docs = spark.createDataFrame(rows + mixed + [(2000, "1 2 3", None, "none")], "doc_id long, text string, lang string, source string")
    network = language_id.fit(docs)
    scores = {x.doc_id: x.score for x in language_id.predict(docs, network).collect()}
    kept = {x.doc_id for x in language_id.with_language(docs).collect()}
    assert kept == {k for k, s in scores.items() if s >= language_id.MIN_SCORE and k != 2000}
    assert {k for k, *_ in rows} <= kept and language_id.MIN_SCORE == 0.5
    flat = language_id.Network(network.langs)
    flat.p = {k: np.zeros_like(v) for k, v in flat.p.items()}
    monkeypatch.setattr(language_id, "fit", lambda d: flat)
    assert language_id.with_language(docs).count() == 0
