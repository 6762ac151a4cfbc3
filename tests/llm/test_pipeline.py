"""The pipeline, stage by stage, against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

import corpus_pipeline
from tests.llm.test_text_operators import awkward, brute_classes, brute_lines, brute_model
from voxframe.llm import decontaminate, kneser_ney, words

SF = "/root/testdata/sf0.01"


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 400")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    columns = docs.columns
    bad = {r["doc_id"] for r in kneser_ney.classify(docs, labels).where("rejected").collect()}
    now = corpus_pipeline.quality(spark, docs, SF)
    texts = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] not in bad}
    assert now.columns == columns and {r["doc_id"]: r["text"] for r in now.collect()} == texts

    now = corpus_pipeline.lines(spark, now, SF).cache()
    texts = {d: x[2] for d, x in brute_lines(sorted(texts.items())).items()}
    assert now.columns == columns and {r["doc_id"]: (r["text"], r["n_chars"]) for r in now.collect()} == {d: (t, len(t)) for d, t in texts.items()}

    now = corpus_pipeline.near_duplicates(spark, now, SF)
    first = brute_classes(sorted(texts.items()))
    texts = {d: t for d, t in texts.items() if first[d][1] == d}
    assert now.columns == columns and {r["doc_id"] for r in now.collect()} == set(texts)

    leaks = {r["doc_id"] for r in decontaminate.find_leaks(now, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert {d for d, t in texts.items() if any(i in t for i in items)} <= leaks
    now = corpus_pipeline.decontamination(spark, now, SF)
    texts = {d: t for d, t in texts.items() if d not in leaks}
    assert now.columns == columns and {r["doc_id"] for r in now.collect()} == set(texts)

    library = words.tokenizer()
    got = {r["doc_id"]: r for r in corpus_pipeline.tokens(spark, now, SF).collect()}
    assert set(got) == set(texts)
    for d, t in texts.items():
        ids = library.encode(t, add_special_tokens=False).ids
        assert got[d]["ids"] == ids and got[d]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stage_on_awkward_rows(spark, name, stage):
    df = awkward(spark)
    got = stage(spark, df, SF)
    if stage is not corpus_pipeline.tokens:
        assert got.columns == df.columns
    assert got.count() <= df.count() and stage(spark, df.limit(0), SF).count() == 0


def quantile(values, q):
    return sorted(values)[max(0, int(np.ceil(q * len(values))) - 1)]


def brute_rejected(rows, good, held, toxic):
    """Documents of one language that the classifier rejects, by the definition: models from dictionaries, thresholds by sorting."""
    order = kneser_ney.ORDER
    plain, bad = brute_model([rows[d] for d in sorted(good - held)], order), brute_model([rows[d] for d in sorted(toxic)], order)
    loss, peak, size = {}, {}, {}
    for d, t in rows.items():
        b = b"\0" * (order - 1) + t.encode() + b"\0"
        grams = [b[i : i + order] for i in range(len(b) - order + 1)]
        p, q = (np.log([m(g) for g in grams]) for m in (plain, bad))
        window = kneser_ney.TOXIC_WINDOW
        loss[d], size[d] = -p.sum(), len(grams)
        peak[d] = max((q - p)[i : i + window].sum() for i in range(max(1, len(grams) - window + 1)))
    mean = sum(loss[d] for d in good - held) / sum(size[d] for d in good - held)
    smooth = {d: (loss[d] + kneser_ney.PRIOR * mean) / (size[d] + kneser_ney.PRIOR) for d in rows}
    limit, most = (quantile([x[d] for d in held], kneser_ney.QUANTILE) for x in (smooth, peak))
    return {d for d in rows if round(float(np.exp(smooth[d])), 9) > round(float(np.exp(limit)), 9) or round(peak[d], 6) > round(most, 6)}


def edits(item, text):
    """The least edit distance of an item to any part of a text, by the table of the definition."""
    row = np.arange(len(item) + 1)
    least = row[-1]
    for c in text:
        new = np.zeros_like(row)
        for i in range(1, len(row)):
            new[i] = min(row[i - 1] + (item[i - 1] != c), row[i] + 1, new[i - 1] + 1)
        row = new
        least = min(least, row[-1])
    return least


def test_run_equals_brute_force(spark, tmp_path):
    """run() as a whole on small tables with all that its stages look for, against the stages' definitions."""
    r = random.Random(21)
    words_ = ["".join(r.choice("abcdeilmnorstu") for _ in range(r.randint(2, 7))) for _ in range(50)]
    say = lambda n: " ".join(r.choice(words_) for _ in range(n)).capitalize() + "."
    items = [(i, say(9)) for i in range(3)]
    texts = [" ".join(say(r.randint(5, 12)) for _ in range(3)) for _ in range(50)]
    texts += ["".join(r.choice("#@$%qxzjkw&*0189") for _ in range(150)) for _ in range(4)]  # junk
    texts += [texts[i] + " zzgrukk zzgrukk " + say(8) for i in range(8)]  # toxic
    texts += [texts[3], texts[4].replace(" ", "  "), texts[5] + " end"] + [say(6) + " " + items[0][1] + " " + say(6), say(6) + items[1][1].replace("a", "e", 1)]
    line = "This line is in many documents of the table"
    texts += [say(20) + "\n" + line + "\n" + say(12) for _ in range(3)] + ["", None, "x"]
    labels = [(i, 1, 0) for i in range(50)] + [(i, 0, 0) for i in range(50, 54)] + [(i, 1, 1) for i in range(54, 60)]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {x["doc_id"]: x for x in corpus_pipeline.run(spark, f"file://{tmp_path}").collect()}

    told = {x["doc_id"]: x["held"] for x in kneser_ney.trusted(spark.read.parquet(f"{tmp_path}/labels.parquet")).collect()}
    rejected = brute_rejected({i: t or "" for i, t in enumerate(texts)}, set(told), {d for d, h in told.items() if h}, set(range(54, 60)))
    assert set(range(50, 60)) <= rejected
    now = {i: t for i, t in enumerate(texts) if i not in rejected}
    now = {d: x[2] for d, x in brute_lines(sorted(now.items())).items()}
    first = brute_classes(sorted(now.items()))
    now = {d: t for d, t in now.items() if first[d][1] == d}
    normal = lambda t: re.sub("[^a-z0-9]+", " ", t.lower()).strip()
    budget = lambda t: int(decontaminate.ERROR_RATE * len(t))
    now = {d: t for d, t in now.items() if all(edits(normal(i), normal(t)) > budget(normal(i)) for _, i in items)}
    library = words.tokenizer()
    assert {d: x["ids"] for d, x in got.items()} == {d: library.encode(t, add_special_tokens=False).ids for d, t in now.items()}
    assert 20 < len(now) < len(texts) - 12
