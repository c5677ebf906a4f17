"""The corpus pipeline against what each stage must do, computed directly."""

import random
from collections import Counter

import pytest

import corpus_pipeline
from pliego.llm import decontam, mixing

from test_near_copies import least_of_groups

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    r = random.Random(8)
    word = lambda: "".join(r.choice("aeioulrstn") for _ in range(r.randint(3, 7)))
    text = lambda n: [word() for _ in range(n)]
    rows, labels, items = [], [], [(k, " ".join(text(25))) for k in range(5)]
    for i in range(300):
        words, bad = text(r.randint(60, 200)), i % 4 == 1
        if bad:
            for w in r.sample(["zorgo", "zorgen", "blatt", "krupf", "krupfig"], 3):
                words.insert(r.randrange(len(words)), w)
        labels.append((i, 0, int(bad)))
        rows.append([i, " ".join(words)])
    clean = [x for x in rows if x[0] % 4 != 1]
    for k in range(40):
        copy = clean[k][1] if k % 2 else clean[k][1] + " eol"
        rows.append([1000 + k, copy])
    for k in range(20):
        rows.append([2000 + k, " ".join(text(50)) + " " + items[k % 5][1].upper() + " " + " ".join(text(50))])
    full = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in rows] + [(3000, None, None, None, None), (3001, "", "en", "s1", 0)]
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(full, COLUMNS).repartition(3).write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
    return str(path), full, items


def test_stages_in_turn(spark, corpus, tmp_path):
    path, full, items = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, path)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "mixing", "sharding"]
    for name in list(seen)[:-1]:
        assert seen[name].columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = lambda n: Counter(r["doc_id"] for r in seen[n].collect())
    every = {x[0]: x for x in full}
    toxic = {i for i in every if i < 300 and i % 4 == 1}
    kept = ids("toxicity")
    assert set(every) - set(kept) == toxic
    # 1000 + k copies (odd k) or nearly copies (one word more) an earlier clean document; the two without words are alike.
    single = ids("near_dedup")
    order = sorted(kept)
    assert set(single) == {order[i] for i in least_of_groups([every[i][1] for i in order])} and set(single.values()) == {1}
    assert not set(single) & {1000 + k for k in range(40)} and 3001 not in single and 3000 in single
    matcher = decontam.Matcher(items)
    clean = ids("decontamination")
    assert set(clean) == {i for i in single if not matcher.find(every[i][1] or "")} and len(single) - len(clean) == 20
    drawn = {r["row"]["doc_id"]: r["copies"] for r in mixing.mixed(seen["decontamination"]).collect()}
    mixed = ids("mixing")
    assert mixed == Counter({i: n for i, n in drawn.items() if n})
    shards = seen["sharding"].collect()
    assert Counter(r["doc_id"] for r in shards) == mixed
    slots = {}
    for r in shards:
        assert tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) == every[r["doc_id"]]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_run_gives_the_same_rows(spark, corpus):
    path, *_ = corpus
    first, again = (sorted((r["doc_id"], r["shard"]) for r in corpus_pipeline.run(spark, path).collect()) for _ in range(2))
    assert first and first == again

