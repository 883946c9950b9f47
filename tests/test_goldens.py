import math
import random
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from grainmill.functions import bpe
from grainmill.functions import columns as C
from grainmill.operators import corpus, decoder, monitor, packing, runs, scoring
from grainmill.plans import catalog
from grainmill.sources import corpus as source
from grainmill.sources import sinks

STREAM = [(0, "1 2 3 99"), (1, "4 5 6"), (2, "7 8 9 10 11 12 13 14")]


def ids(spark):
    rows = [(k, t.split()) for k, t in STREAM]
    return spark.createDataFrame(rows, "doc_id long, ids array<string>").select("doc_id", C.with_eos(F.col("ids"), F.lit("99")).alias("ids"))


def test_blocks_of_the_golden_stream(spark):
    flat = "1 2 3 99 4 5 6 99 7 8 9 10 11 12 13 14 99".split()
    got = {r.block: r for r in packing.pairs(packing.blocks(ids(spark), 3), 3).collect()}
    assert sorted(got) == [0, 1, 2, 3, 4]
    for k in range(5):
        assert got[k].x == flat[3 * k : 3 * k + 3] and got[k].y == flat[3 * k + 1 : 3 * k + 4]
    assert {r.block for r in packing.of_rank(packing.blocks(ids(spark), 3), 1, 2).collect()} == {1, 3}


def test_epochs_roll_over_and_too_few_tokens(spark):
    b = spark.range(7).withColumnRenamed("id", "batch")
    assert [(r.epoch, r.block) for r in packing.epochs(5, 2, 1, b).orderBy("batch").collect()] == [(0, 1), (0, 3), (1, 1), (1, 3), (2, 1), (2, 3), (3, 1)]
    with pytest.raises(ValueError, match="too few tokens"):
        packing.epochs(1, 2, 1, b)


def test_position_names_what_changed():
    packing.check_position({"B": 1}, {"B": 1})
    with pytest.raises(ValueError, match="rank"):
        packing.check_position({"rank": 0}, {"rank": 1})


def test_records_count_raw_rows_and_resume(spark, tmp_path):
    for name, texts in (("train-0", ["hello", None, "", "world"]), ("train-1", ["old", None, "resume here", "last"])):
        pq.write_table(pa.table({"text": pa.array(texts, pa.string())}), tmp_path / f"{name}.parquet", row_group_size=2)
    names = source.shards(source.files(spark, str(tmp_path)), "train")
    assert [(r.shard, r.row, r.text) for r in source.records(spark, names).orderBy("shard", "row").collect()] == [(0, 1, "hello"), (0, 4, "world"), (1, 1, "old"), (1, 3, "resume here"), (1, 4, "last")]
    assert [(r.row, r.text) for r in source.records(spark, names, (1, 2)).orderBy("row").collect()] == [(3, "resume here"), (4, "last")]
    with pytest.raises(ValueError, match="No Parquet files"):
        source.shards(names, "test")


def test_a_folder_of_files_is_one_shard(spark, tmp_path):
    folder = tmp_path / "a b" / "documents.parquet"
    folder.mkdir(parents=True)
    for k, texts in enumerate((["a", None, "b"], [""], ["c", "d"])):
        pq.write_table(pa.table({"doc_id": pa.array(range(len(texts))), "text": pa.array(texts, pa.string())}), folder / f"part-{k}.parquet", row_group_size=2)

    def got(*a, **b):
        return [(r.shard, r.row, r.text) for r in source.records(spark, [str(folder)], *a, **b).orderBy("row").collect()]

    assert got() == [(0, 1, "a"), (0, 3, "b"), (0, 5, "c"), (0, 6, "d")]
    assert got((0, 3)) == [(0, 5, "c"), (0, 6, "d")] and got((0, 5)) == [(0, 6, "d")] and got((0, 6)) == [] and got((1, 0)) == []
    assert [r for _, r, _ in got(blank=True)] == [1, 2, 3, 4, 5, 6]
    for name, after in (("records_with_cursor", 0), ("texts", 0), ("resume_scan", 500)):
        assert catalog.QUERIES[name](spark, str(folder.parent)).count() == max(0, 6 - after)


def test_logs_of_any_breaks_are_read_in_splits(spark, tmp_path):
    folder = tmp_path / "a log"
    folder.mkdir()
    texts = ["a\r\nb\u2028c\n\nd\r\re\n", "", "f\ng", "h\x0b", "i\rj\x85", "\n\r\n", "k\x1cl\nm\r", "end\n" * 50]
    for k, x in enumerate(texts):
        (folder / f"part-{k}").write_bytes(x.encode())
    frame = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    want = [x for r in frame.select("k", monitor.lines(F.col("t")).alias("x")).orderBy("k").collect() for x in r.x]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7")
    try:
        got = monitor.read_log(spark, str(folder)).orderBy("line_no").collect()
        assert [(r.line_no, r.line) for r in got] == list(enumerate(want))
        plain = folder / "part-7"
        log = monitor.read_log(spark, str(plain))
        assert log.rdd.getNumPartitions() > 1  # whole, a log was one task's work
        assert [(r.line_no, r.line) for r in log.orderBy("line_no").collect()] == [(k, "end") for k in range(50)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_texts_are_scored_by_windows(spark, monkeypatch):
    model = decoder.Decoder.random(decoder.Shape(vocabulary=256, context=4, layers=1, heads=2, width=4))
    texts = ["abcdefgh\u00e9x", "", None, "abcd", "a", "abcde", "xyz"]
    frame = spark.createDataFrame(list(enumerate(texts)), "id long, text string").coalesce(1)
    monkeypatch.setattr(decoder, "TOGETHER", 8)
    got = {r.id: (r.tokens, r.loss) for r in decoder.scored_texts(frame, model, 4).collect()}
    assert sorted(got) == [0, 3, 4, 5, 6] and got[4] == (1, None)
    for k in (0, 3, 5, 6):
        b = list(texts[k].encode())
        each = [model.losses(np.array([b[x : x + 4]])).mean() for x in range(0, len(b), 4) if len(b) - x > 1]
        assert got[k][0] == len(b) and abs(got[k][1] - np.mean(each)) < 1e-9
    plan = catalog.QUERIES["forward_loss"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan and "Generate" not in plan  # each byte went through a pattern


def test_bits_per_byte_of_empty_texts(spark, tmp_path):
    rows = {"doc_id": [0, 1, 2, 3], "text": ["", "", None, "ab"], "n_chars": [0, 2, 2, 2]}
    pq.write_table(pa.table(rows), tmp_path / "documents.parquet")
    got = [r.bits for r in catalog.QUERIES["bits_per_byte"](spark, str(tmp_path)).orderBy("doc_id").collect()]
    assert math.isnan(got[0]) and got[1] == math.inf and got[2] is None and got[3] == round(3.5 / math.log(2), 8)  # as DuckDB divides


def test_offsets_span_buckets(spark):
    t = spark.range(20000).select(F.col("id").alias("doc_id"), (F.col("id") % 3 + 1).alias("n"))
    got = {r.doc_id: r.off for r in packing.offsets(t).collect()}
    at = 0
    for k in range(20000):
        assert got[k] == at
        at += k % 3 + 1


def test_log_lines(spark):
    raw = "0 train 4.0\r\n1 val 3.0\n1 train 3.5\n2 train 2"
    log = spark.createDataFrame([(raw,)], "v string").select(F.posexplode(monitor.lines(F.col("v"))).alias("line_no", "line"))
    assert [r.line for r in log.orderBy("line_no").collect()] == ["0 train 4.0", "1 val 3.0", "1 train 3.5"]
    kept = monitor.prune(log, 1)
    assert [r.line for r in kept.orderBy("line_no").collect()] == ["0 train 4.0", "1 val 3.0"]
    assert monitor.changed(log, kept) and not monitor.changed(kept, kept)


def test_best_step_ties_go_to_the_first_written(spark):
    rows = [("val", 5, 1.0, 0), ("val", 3, 2.0, 1), ("val", 3, 1.0, 2)]
    m = monitor.last_wins(spark.createDataFrame(rows, "metric string, step long, value double, line_no int"))
    assert monitor.best_step(m).first().step == 5


def test_choices_ties_and_nan(spark):
    rows = [(0, 0, 1.0), (0, 1, 2.0), (1, 0, 1.0), (1, 1, 1.0), (2, 0, float("nan")), (2, 1, 1.0)]
    got = scoring.choose(spark.createDataFrame(rows, "item int, choice int, loss double"))
    assert {r.item: r.choice for r in got.collect()} == {0: 0, 1: -1, 2: -1}


def test_parameters_and_batches(spark):
    got = runs.presets(spark).select("name", runs.parameters(F.col("layers"), F.col("width")).alias("n"))
    assert {r.name: r.n for r in got.collect()} == {"small": 30357504, "medium": 51500032, "gpt2": 124475904}
    assert runs.batch_plan(524288, 64, 1024, 8) == 1
    with pytest.raises(ValueError):
        runs.batch_plan(524288, 63, 1024, 1)


def test_save_once(spark, tmp_path):
    path = str(tmp_path / "c")
    runs.save_once(spark.range(3), path)
    assert spark.read.parquet(path).count() == 3
    with pytest.raises(FileExistsError):
        runs.save_once(spark.range(3), path)


def test_tail(spark, tmp_path):
    (tmp_path / "s.txt").write_text("x" * 10 + "end")
    r = source.tail(spark, str(tmp_path / "s.txt"), 3).first()
    assert (r.text, r.truncated) == ("end", True)


def test_merges(spark):
    assert bpe.learn({"aab": 2, "ab": 1}, 2) == [("a", "b"), ("a", "ab")]
    assert bpe.merged("aaabab", ("a", "b")) == ["a", "a", "ab", "ab"] and bpe.merged("aaa", ("a", "a")) == ["aa", "a"]


def slow_merges(counts, n):
    words, out = [(list(w), c) for w, c in counts.items()], []
    for _ in range(n):
        total = Counter()
        for parts, c in words:
            for p in zip(parts, parts[1:]):
                total[p] += c
        if not total:
            break
        pair = min(total, key=lambda p: (-total[p], p))
        out.append(pair)
        words = [(bpe.merged(parts, pair), c) for parts, c in words]
    return out


def test_merges_on_the_driver_and_as_a_table_are_those_of_brute_force(spark):
    random.seed(3)
    counts = {"".join(random.choices("abcde", k=random.randint(1, 9))): random.randint(1, 30) for _ in range(150)}
    want = slow_merges(counts, 60)
    frame = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert bpe.learn(counts, 60) == want
    assert bpe.learn_merges(frame, 60) == want
    assert bpe.learn_merges(frame, 25, words=10) == want[:25]
    assert bpe.learn({"ab": 1}, 9) == [("a", "b")]


def test_merges_of_many_words_on_the_driver(spark, monkeypatch):
    random.seed(5)
    counts = {"".join(random.choices("aab\u00e9\U0001f600", k=random.randint(1, 12))): random.randint(1, 4) for _ in range(300)}
    monkeypatch.setattr(bpe, "ALIKE", 50)  # arrays of one weight, and one of the rest
    monkeypatch.setattr(bpe, "BLOCK", 100)
    assert bpe.WORDS >= 10_000_000  # a vocabulary of 2,000,000 words took some hundred distributed rounds
    frame = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert bpe.learn(counts, 80) == bpe.learn_merges(frame, 80) == slow_merges(counts, 80)


def test_words_are_counted_and_encoded_from_texts(spark, monkeypatch):
    texts = ["One two, ONE", None, "", "\u00e9t\u00e9 \u212aelvin \u0130x", "one_2 x"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(corpus, "HELD", 2)
    want = Counter(r.w for r in frame.select(F.explode(C.words(F.lower("text"))).alias("w")).collect())
    assert {r.word: r.n for r in corpus.word_counts(frame).collect()} == want
    assert bpe.alphabet(frame) == sorted(set("".join(want)))
    v = bpe.WordVocabulary(["one", "x"])
    rows = frame.select("doc_id", F.lower("text").alias("text"))
    words = frame.select("doc_id", C.words(F.lower("text")).alias("words"))
    got = {r.doc_id: r.ids for r in bpe.encoded(rows, v).collect()}
    assert got == {r.doc_id: r.ids for r in bpe.encoded(words, v).collect()} and got[0] == [0, 2, 0] and got[1] is None and got[2] == []
    plan = catalog.QUERIES["word_ids"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan  # JVM patterns took most of the time


def test_words_become_ids(spark):
    v = bpe.Vocabulary("ab", [("a", "b"), ("ab", "ab")])
    assert v.encode("ababa") == [v.ids["abab"], v.ids["a"]] and v.encode("xa") == [v.unknown, v.ids["a"]]
    rows = spark.createDataFrame([(1, ["ab", "b"]), (2, []), (3, None)], "doc_id long, words array<string>")
    assert {r.doc_id: r.ids for r in bpe.encoded(rows, v).collect()} == {1: [v.ids["ab"], v.ids["b"]], 2: [], 3: None}


def test_tokenized_once(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = packing.tokenized(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1
    plan = packing.blocks(packing.tokenized(docs), 64)._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan  # the tokens are read from a table


def test_splits_are_packed_apart(spark):
    rows = [("a", 1, ["x"] * 4), ("b", 2, ["y"] * 5), ("a", 3, ["z"] * 3)]
    got = {(r.split, r.block): r.w for r in packing.blocks(spark.createDataFrame(rows, "split string, doc_id long, ids array<string>"), 3, ["split"]).collect()}
    assert got == {("a", 0): ["x"] * 4, ("a", 1): ["x", "z", "z", "z"], ("b", 0): ["y"] * 4}


def test_steps_and_values_are_read_as_python_does(spark):
    cases = ["+5", "1_0", "-0", "-5", "5.0", "_1", "1__0", "1_", "", "007"]
    values = ["1_000", "1f", "1e1_0", ".5", "5.", "_1", "+1", "-0.0", "inf", "nan", "1e400", "1 ", "0x1"]

    def want(step, value):
        try:
            return int(step) >= 0 and math.isfinite(float(value)) and float(value) >= 0
        except ValueError:
            return False

    rows = [(s, "1") for s in cases if s] + [("1", v) for v in values if v == v.strip()]
    log = spark.createDataFrame([(k, f"\t{s}\u00a0train {v}\x1c") for k, (s, v) in enumerate(rows)], "line_no int, line string")
    got = {r.line_no: r.status for r in monitor.parse(log).collect()}
    assert got == {k: "valid" if want(*r) else "invalid" for k, r in enumerate(rows)}


def test_pruning_a_file_keeps_a_copy(spark, tmp_path):
    path = tmp_path / "log.txt"
    path.write_bytes(b"\t0 train 4.0\r\n1 val 3.0\n1 train 3.5\n\n2 train 2")
    before = path.read_bytes()
    copy = monitor.prune_file(spark, str(path), 1)
    assert path.read_bytes() == b"\t0 train 4.0\r\n1 val 3.0\n"
    assert Path(copy.removeprefix("file:")).read_bytes() == before
    assert monitor.prune_file(spark, str(path), 1) is None
    assert monitor.prune_file(spark, str(tmp_path / "new.txt"), 1) is None and (tmp_path / "new.txt").read_bytes() == b""
    assert [r.line for r in monitor.read_log(spark, str(path)).orderBy("line_no").collect()] == ["\t0 train 4.0", "1 val 3.0"]
    assert monitor.read_log(spark, str(tmp_path / "none.txt")).isEmpty()


def test_complete_lines(spark):
    for text in ("", "\n", "a\nb\n", "a\nb", "a\rb\r", "a\r\nb\x0c", "a\x1cb\n\n", "\r"):
        want = text.splitlines()
        if text and not text.endswith("\n"):
            want = want[:-1]
        got = spark.createDataFrame([(text,)], "v string").select(monitor.lines(F.col("v")).alias("x")).first().x
        assert got == want, repr(text)


def test_trailing_over_runs(spark, monkeypatch):
    monkeypatch.setattr(monitor, "SPAN", 8)
    steps = sorted(random.Random(2).sample(range(200), 60))
    rows = [("a", s, float(k)) for k, s in enumerate(steps)]
    got = {r.step: r.mean for r in monitor.trailing(spark.createDataFrame(rows, "metric string, step long, value double"), 5).collect()}
    assert got == {s: sum(range(max(0, k - 4), k + 1)) / min(k + 1, 5) for k, s in enumerate(steps)}


def test_unused_folders(spark, tmp_path):
    runs.require_unused(spark, str(tmp_path / "none"))
    (tmp_path / "log.txt").write_text("")
    runs.require_unused(spark, str(tmp_path))
    (tmp_path / "log.txt").write_text("0 train 1\n")
    with pytest.raises(FileExistsError):
        runs.require_unused(spark, str(tmp_path))
    (tmp_path / "log.txt").unlink()
    (tmp_path / "model_00010.pt").write_text("")
    with pytest.raises(FileExistsError):
        runs.require_unused(spark, str(tmp_path))
    assert [r.path.rsplit("/", 1)[-1] for r in source.checkpoints(spark, [str(tmp_path), str(tmp_path), str(tmp_path / "none")]).collect()] == ["model_00010.pt"]


def test_exports(spark):
    made = runs.weights(runs.preset(spark, "small"))
    assert {r.decayed: r.parameters for r in runs.decay_groups(made).collect()} == {True: 51328 * 384 + 72 * 384**2, False: 80 * 384}
    with pytest.raises(ValueError, match="Unknown"):
        runs.preset(spark, "large")
    assert runs.architecture(None, (6, 6, 384), (12, 12, 768)) == (6, 6, 384) and runs.architecture(None, None, (1, 1, 1)) == (1, 1, 1)
    with pytest.raises(ValueError):
        runs.architecture((8, 8, 512), (6, 6, 384), (12, 12, 768))
    names = [*runs.FILES, "model.safetensors", "notes.txt", "training_state.pt"]
    files = spark.createDataFrame([(n,) for n in names], "name string")
    got = {(r.name, r.action) for r in runs.publication(files, False, 7).collect()}
    assert got == {(n, "upload") for n in names if n != "notes.txt"} | {("training_state.pt", "delete")}
    with pytest.raises(ValueError, match="tokenizer_config.json"):
        runs.publication(files.where("name <> 'tokenizer_config.json'"), True, 7)
    with pytest.raises(ValueError, match="T"):
        runs.check_resume(spark.createDataFrame([("T", "1")], "key string, value string"), spark.createDataFrame([("T", "2")], "key string, value string"), 1, 1)
    for bad in (("2", "0", 1, 1), ("0", "x", 1, 1), ("0", "0", 0, 1), ("0", "0", 1, 0)):
        with pytest.raises(ValueError):
            runs.check_flags(*bad)
    assert packing.start(2, 4)["next_block"] == 0


def test_logs_are_appended_to(spark, tmp_path):
    path = str(tmp_path / "log")
    m = spark.createDataFrame([(1, "train", 2.5), (1, "val", 2.25)], "step long, metric string, value double")
    sinks.append_metrics(m, path)
    sinks.append_metrics(m.limit(1), path)
    assert sorted(r.value for r in spark.read.text(path).collect()) == ["1 train 2.500000", "1 train 2.500000", "1 val 2.2500"]
    sinks.append_samples(spark.createDataFrame([(5, 0, "hello")], "step long, sample int, text string"), str(tmp_path / "s"))
    assert [r.value for r in spark.read.text(str(tmp_path / "s"), wholetext=True).collect()] == ["step 5 sample 0: hello\n\n"]
    write = sinks.metrics_sink(str(tmp_path / "stream"))
    for _ in range(2):  # a batch that is run again
        write(m, 0)
    assert spark.read.text(str(tmp_path / "stream")).count() == 2


def test_decoder(spark):
    shape = decoder.Shape(vocabulary=11, context=8, layers=2, heads=2, width=6)
    model = decoder.Decoder.random(shape)
    r = np.random.default_rng(4)
    for k, v in model.w.items():
        model.w[k] = r.normal(0, 0.5, v.shape)

    def slow(ids):  # one position at a time, in plain loops
        w, c = model.w, shape.width

        def norm(x, n):
            d = x - x.mean()
            return d / np.sqrt((d * d).mean() + 1e-5) * w[n + ".weight"] + w[n + ".bias"]

        xs = [w["wte.weight"][t] + w["wpe.weight"][k] for k, t in enumerate(ids)]
        for k in range(shape.layers):
            p = f"h.{k}."
            qkv = [w[p + "attn.c_attn.weight"] @ norm(x, p + "ln_1") + w[p + "attn.c_attn.bias"] for x in xs]
            new = []
            for i in range(len(xs)):
                out = []
                for h in range(shape.heads):
                    s = c // shape.heads
                    q = qkv[i][h * s : (h + 1) * s]
                    score = np.array([q @ qkv[j][c + h * s : c + (h + 1) * s] / math.sqrt(s) for j in range(i + 1)])
                    a = np.exp(score) / np.exp(score).sum()
                    out.append(sum(a[j] * qkv[j][2 * c + h * s : 2 * c + (h + 1) * s] for j in range(i + 1)))
                new.append(xs[i] + w[p + "attn.c_proj.weight"] @ np.concatenate(out) + w[p + "attn.c_proj.bias"])
            xs = new
            for i, x in enumerate(xs):
                z = w[p + "mlp.c_fc.weight"] @ norm(x, p + "ln_2") + w[p + "mlp.c_fc.bias"]
                g = np.array([0.5 * v * (1 + math.tanh(math.sqrt(2 / math.pi) * (v + 0.044715 * v**3))) for v in z])
                xs[i] = x + w[p + "mlp.c_proj.weight"] @ g + w[p + "mlp.c_proj.bias"]
        return [w["wte.weight"] @ norm(x, "ln_f") for x in xs]

    ids = [3, 1, 4, 1, 5, 9]
    assert np.allclose(model.logits(np.array([ids]))[0], slow(ids))
    z = slow(ids[:-1])
    want = np.mean([np.log(np.exp(z[k]).sum()) - z[k][ids[k + 1]] for k in range(5)])
    rows = spark.createDataFrame([(1, ids), (2, [3]), (3, None), (4, ids)], "id long, ids array<int>")
    got = {r.id: (r.tokens, r.loss) for r in decoder.scored(rows, model).collect()}
    assert got[2] == (1, None) and got[3] == (0, None) and abs(got[1][1] - want) < 1e-9 and got[1] == got[4]
    made = decoder.samples(rows.where("id = 1"), model, length=8, copies=3, top=2, vocabulary=9).collect()
    for r in made:
        assert r.ids[:6] == ids and len(r.ids) == 8
        for k in (6, 7):
            assert r.ids[k] in np.argsort(-np.array(slow(r.ids[:k])[-1][:9]))[:2]
    with pytest.raises(ValueError):
        model.logits(np.zeros((1, 9), int))
    with pytest.raises(ValueError):
        decoder.Shape(1, 1, 1, 4, 6)


def test_split_files_prune_columns(spark):
    plan = packing.tokenized(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))._jdf.queryExecution().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
