"""The pipeline, stage by stage on its own input, against brute force."""

import random

import sentencepiece

import corpus_pipeline as P
from logloom.llm.sentencepiece_dropout import default_model

from .test_line_dedup import brute
from .test_text_dedup import brute_components, shingles
from .test_url_mixing_lang import brute_mix, fused, text

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(31)
    rows, passage = [], [text(rng, "en", 6) for _ in range(4)]
    for i in range(160):
        lang = rng.choice(["en", "de", "fr"])
        lines = [text(rng, lang, rng.randrange(4, 9)) for _ in range(rng.randrange(1, 9))]
        if i % 9 == 0:
            lines[1:1] = passage
        body = "\n".join(lines)
        if i % 7 == 3:
            body = rows[i - 3][1]
        if i % 11 == 5:
            body = rows[i - 2][1] + " th"
        rows.append((i, body, lang if i % 6 else None, f"src{rng.randrange(16)}", len(body)))
    return rows + [(900, None, "en", "src1", None), (901, "", "en", None, 0), rows[4]]


def test_stages_and_run(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, COLUMNS).repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(5, "http://x.example.org/en/1", '<html lang="en">')], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    after = {}
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / f"s{k}"))
        docs = spark.read.parquet(str(tmp_path / f"s{k}"))
        after[name] = docs.collect()
        if name != "sentencepiece":
            assert docs.columns == [c.split()[0] for c in COLUMNS.split(", ")]
    assert list(after) == ["language_id", "line_dedup", "jaccard_join", "mixing", "sentencepiece"]

    clean = [r for r in rows if r[1]]
    assert sorted((r.doc_id, r.text) for r in after["language_id"]) == sorted(r[:2] for r in clean)
    # about SAMPLE labelled rows a language: all of these
    facts = {5: ("en", "/en", "x.example.org")}
    told = [(r[0], r[1], k) for r, (k, p) in zip(rows, fused([r[:4] for r in rows], facts)) if k != "und" and p >= 0.5]
    assert sorted((r.doc_id, r.text, r.lang) for r in after["language_id"]) == sorted(told) and {k for _, _, k in told} == {"en", "de", "fr"}

    before = [(r.doc_id, r.text) for r in after["language_id"]]
    once = list(dict.fromkeys(before))  # a repeated row is judged as one
    want = dict(zip(once, brute(once)))
    assert sorted((r.doc_id, r.text, r.n_chars) for r in after["line_dedup"]) == sorted((d, want[d, t], len(want[d, t])) for d, t in before)
    assert any(want[b] != b[1] for b in once)

    before = [(r.doc_id, r.text) for r in after["line_dedup"]]
    low = {c for _, n, c in brute_components(before) if n}
    kept = [r.doc_id for r in after["jaccard_join"] if shingles(r.text)]
    assert sorted(kept) == sorted(low) and len(low) < len(before)

    before, taken = after["jaccard_join"], after["mixing"]
    assert {(r.doc_id, r.text) for r in taken} <= {(r.doc_id, r.text) for r in before} and len({r.doc_id for r in taken}) == len(taken)
    times = brute_mix([(r.doc_id, r.text, r.lang, r.source) for r in before], P.MIX["part"], P.MIX["epochs"])
    assert sorted(r.doc_id for r in taken) == sorted(r.doc_id for r, n in zip(before, times) if n)

    lib = sentencepiece.SentencePieceProcessor(model_file=default_model())
    for r in after["sentencepiece"]:
        assert r.round_trip and lib.decode(r.pieces) == r.text and r.n_pieces == len(r.pieces) >= len(lib.encode(r.text)) * 0.9
    assert any(r.pieces != lib.encode(r.text) for r in after["sentencepiece"])
    assert sorted((r.doc_id, r.pieces) for r in P.run(spark, str(tmp_path)).collect()) == sorted((r.doc_id, r.pieces) for r in after["sentencepiece"])


def run_stages(spark, tmp_path, rows, schema, pages):
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    after = {}
    for k, (name, stage) in enumerate(P.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"s{k}"))
        docs = spark.read.parquet(str(tmp_path / f"s{k}"))
        after[name] = docs
    return after


def test_empty_tables(spark, tmp_path):
    after = run_stages(spark, tmp_path, [], COLUMNS, [])
    assert all(df.count() == 0 for df in after.values()) and P.run(spark, str(tmp_path)).count() == 0


def test_very_long_texts_and_clashing_columns(spark, tmp_path):
    """Columns named as the stages' own go through unchanged, and a text of megabytes like any other."""
    rng = random.Random(7)
    long_ = " ".join(text(rng, "en", 7) for _ in range(60000))
    extra = "_id long, _h string, found int, spans string, pieces string, kept string, label int, row int, component string, n int"
    rows = []
    for i in range(40):
        lang = "en" if i % 2 else "de"
        body = text(rng, lang, 60) if i else long_
        rows.append((i, body, lang, "s", len(body), i, "h", i, None, "p", "k", 7, i, "c", i))
    rows.append((50, rows[3][1], "en", "s", 5, 50, "h", 50, None, "p", "k", 7, 50, "c", 50))
    after = run_stages(spark, tmp_path, rows, COLUMNS + ", " + extra, [(0, None, None), (None, "http://x.org/", "")])
    names = [c.split()[0] for c in (COLUMNS + ", " + extra).split(", ")]
    for name, df in after.items():
        assert df.columns[: len(names)] == names or name == "sentencepiece", (name, df.columns)
        for r in df.select("doc_id", "_id", "found", "row", "n", "_h", "kept", "label").collect():
            assert r.doc_id == r["_id"] == r.found == r.row == r.n and (r["_h"], r.kept, r.label) == ("h", "k", 7), name
    assert after["language_id"].count() == 41 and {r.doc_id for r in after["jaccard_join"].select("doc_id").collect()} == set(range(40))
    assert all(r.round_trip for r in after["sentencepiece"].collect())
