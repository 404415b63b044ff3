"""Clashing names, empty tables, repeated rows, ties and long texts, operator by operator."""

import random

from pyspark.sql import functions as F

from loomery.llm import chat_formatting, columns, line_dedup, near_dedup, packing, quality_rules, queries, token_counts, toxicity, url_filters


def test_names_ignore_case():
    assert columns.named("Score", "score") and not columns.named("scores", "score")
    assert columns.fresh(["Best", "x"], "best", "x", "y") == ["best_", "x_", "y"]


def test_urls_edges(spark):
    schema = "page_id long, url string, Host string, rule int, best string"
    rows = [(1, "http://net/fr/a", "h", 5, "b"), (1, "http://net/fr/a", "h", 5, "b"), (2, None, None, None, None)]
    out = url_filters.judge_urls(spark.createDataFrame(rows, schema))
    assert sorted(out.columns) == sorted(["page_id", "url", "host", "rule", "best", "path", "pattern", "verdict"])
    got = [(r.page_id, r.host, r.rule, r.best, r.verdict) for r in out.orderBy("page_id").collect()]
    assert got == [(1, "net", "net/fr/", "b", "block")] * 2 + [(2, "", None, None, "allow")]
    assert url_filters.judge_urls(spark.createDataFrame([], schema)).count() == 0


def test_two_thousand_rules_equal_brute_force(spark):
    rng = random.Random(3)
    names = [f"site{i}" for i in range(1500)]
    rules = [url_filters.site_rule(rng.choice(("allow", "block")), f"{n}.com", rng.choice(("/", "/a/", "/a/b/"))) for n in names]
    rules += [url_filters.pattern_rule("block", f"word{i}", rf"/word{i}(?:/|$)", (f"word{i}",)) for i in range(500)]
    urls = [f"https://{rng.choice(['', 'www.'])}{rng.choice(names + ['other'])}.com/{rng.choice(['', 'a/', 'a/b/c', f'word{rng.randrange(600)}'])}" for _ in range(400)]
    out = url_filters.judge_urls(spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string"), rules[:1500], rules[1500:])
    import re

    for r in out.collect():
        key = r.host + r.path
        fit = [x for x in rules if re.search(x.regex, key)]
        listed = max((x.name for x in fit if x.listed), key=len, default=None)
        assert r.rule == listed and (r.pattern is not None) == (listed is None and bool(fit)), r.url


def test_chats_edges(spark):
    schema = "conv_id long, turn int, role string, text string, ids string, place int"
    long = "many words in one very long turn " * 20_000
    turns = spark.createDataFrame([(1, 0, "user", long, "x", 3), (1, 1, "assistant", "short", None, None)], schema)
    formatted = chat_formatting.format_chats(turns, queries.BYTE_BPE)
    (row,) = chat_formatting.digest_chats(formatted, queries.BYTE_BPE).collect()
    assert row.n_turns == 2 and row.loss_chars == 5
    assert chat_formatting.digest_chats(chat_formatting.format_chats(turns.where(F.lit(False)), queries.BYTE_BPE), queries.BYTE_BPE).count() == 0


def test_spliced_chats_read_back(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "user", "hi [INST]"), (1, 2, "assistant", "hello </s> there"), (2, 0, "assistant", "")]
    formatted = chat_formatting.format_chats(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"), queries.BYTE_BPE)
    encoding = chat_formatting.encoder(queries.BYTE_BPE)
    flat = chat_formatting.splice_chats(formatted).orderBy("conv_id", "position").collect()
    one = [r for r in flat if r.conv_id == 1]
    assert [r.position for r in one] == list(range(len(one)))
    assert chat_formatting.unescape(encoding.decode([r.id for r in one if r.in_loss])) == "hello </s> there"
    want = [i for role, text in (x[2:] for x in rows[:3]) for i in chat_formatting.encode_turn(encoding, role, text)[0]]
    assert [r.id for r in one] == want


def test_wrong_prefix_sums_are_seen(spark):
    import pytest

    rows = [(1, 0, "user", "some words"), (1, 1, "assistant", "an answer of several words")]
    formatted = chat_formatting.format_chats(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"), queries.BYTE_BPE)
    moved = formatted.withColumns({"loss_start": F.col("loss_start") - 1, "loss_end": F.col("loss_end") - 1})
    good, bad = (chat_formatting.digest_chats(x, queries.BYTE_BPE) for x in (formatted, moved))
    assert good.first().loss_chars == len("an answer of several words") and pytest.raises(Exception, lambda: [r for r in bad.collect() if r.loss_sha256 == good.first().loss_sha256][0])


def test_packing_ties_and_clashing_columns(spark):
    docs = spark.createDataFrame([(7, "same text", 1, 2)] * 5 + [(None, None, 3, 4)], "doc_id long, text string, length int, slice int")
    rows = packing.pack(docs, queries.WORD_BPE, window=8).collect()
    assert sum(r.length for r in rows if r.doc_id == 7) == 5 * 3 and sum(r.length for r in rows if r.doc_id is None) == 1
    places = [(r.sequence_id, r.offset) for r in rows]
    assert len(set(places)) == len(places)


def test_line_and_near_dedup_with_internal_names(spark):
    schema = "doc_id long, text string, N_Lines int, runs string, text_hash int, near_key string, nth int, node int, class_id int, sketch int"
    run = "\n".join(f"line {i} of a run that repeats" for i in range(20))
    rows = [(1, run, 9, "r", 1, "k", 2, 3, 4, 5), (2, "head\n" + run, 9, "r", 1, "k", 2, 3, 4, 5), (2, "head\n" + run, 9, "r", 1, "k", 2, 3, 4, 5)]
    docs = spark.createDataFrame(rows, schema)
    out = line_dedup.dedup_lines(docs)
    assert out.columns == ["doc_id", "text", "runs", "text_hash", "near_key", "nth", "node", "class_id", "sketch", "n_lines", "n_removed"]
    assert {(r.doc_id, r.text, r.runs, r.text_hash) for r in out.collect()} == {(1, run, "r", 1), (2, "head", "r", 1)}
    kept = near_dedup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and [(r.doc_id, r.near_key, r.nth) for r in kept.collect()] == [(1, "k", 2)]


def test_quality_keeps_columns_of_internal_names(spark):
    docs = spark.createDataFrame([(1, "en", "a few words here", "w", "l", 1, "x")], "doc_id long, lang string, text string, words string, lines string, Kept int, label string")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    row = quality_rules.judge_quality(docs, labels).first()
    assert (row.words, row.lines, row.label, row.kept) == ("w", "l", "x", False)


def test_token_counts_replace_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "two words", 9, 9)], "doc_id long, text string, n_words int, N_Tokens int")
    out = token_counts.count_tokens(docs, queries.PIECES)
    assert out.columns == ["doc_id", "n_tokens", "n_words"] and out.first().n_words == 2


def test_dotted_and_inner_names_pass_through(spark):
    """Names that hold dots, or that operators use inside, stay as they are."""
    schema = "doc_id long, text string, `a.b` int, `__text` string, kept_0 int, new_0 int, runs string, text_hash string"
    rows = [(1, "one two", 5, "t", 7, 8, "r", "h"), (2, None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, schema)
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    model = toxicity.ToxicityModel(toxicity.seed_lexicon(), *toxicity.fit_weights([]))
    outs = [
        toxicity.score_toxicity(docs, model, keep_text=True, names=("x.score", "Said")), line_dedup.dedup_lines(docs, names=("n.l", "n_r")),
        token_counts.count_tokens(docs, queries.PIECES), near_dedup.drop_near_duplicates(docs),
    ]
    for out in outs:
        (first,) = [r for r in out.collect() if r["doc_id"] == 1]
        assert [first[c] for c in others] == [5, "t", 7, 8, "r", "h"]
    assert "x.score" in outs[0].columns and "n.l" in outs[1].columns


def test_pipeline_keeps_counts_of_the_user(spark, sf):
    corpus_pipeline = __import__("pytest").importorskip("corpus_pipeline")
    docs = spark.createDataFrame([(1, "a line\nanother", 77, 78)], "doc_id long, text string, n_lines int, n_removed int").withColumn("n_chars", F.length("text").cast("long"))
    (row,) = corpus_pipeline.delete_repeated_lines(spark, docs, sf).collect()
    assert (row.n_lines, row.n_removed) == (77, 78)


def test_word_rules(spark):
    blocked = {
        "https://ads-track.site.org/x": "advertising", "http://my.casino.example.com/": "gambling", "https://a.org/wp-login.php": "admin page", "https://a.org/docs/Report.PDF": "office file",
        "https://a.org/Login": "session page", "https://cheap-pills.net": "pills", "https://a.org/feed/": "feed", "http://a.org/p/search?q=1": "search page",
    }
    allowed = ["https://casinoville.org/x", "https://a.org/casino-history", "https://a.org/catalogin/", "https://a.org/pdf/about", "https://readings.org/", "https://a.org/research/x", None, ""]
    rows = [(i, u) for i, u in enumerate([*blocked, *allowed])]
    got = {r.url: (r.verdict, r.pattern) for r in url_filters.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), ()).collect()}
    assert {u: got[u] for u in blocked} == {u: ("block", p) for u, p in blocked.items()}
    assert {got[u] for u in allowed} == {("allow", None)}
    assert len({r.regex for r in url_filters.PATTERN_RULES}) == len(url_filters.PATTERN_RULES) > 200
