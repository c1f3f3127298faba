"""Secrets, personal data, quality and quotes."""

import math
import random
import re

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from siltlog.llm import pii, quality, quotes, secrets
from tests.conftest import SF_DIR

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base(text):
    found = [[m.span() for m in ASSIGN.finditer(text) if len(m[2]) >= 6]]
    found.append([m.span() for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20])
    found.append([m.span() for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24])
    return ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted((a, k, b) for k, own in enumerate(found) for a, b in own))


def test_base_secrets(spark):
    rng = random.Random(5)
    bits = ['password="', "Token = ", "api_key:", "secret", "=", "'abc", "abcdef12", " ", "ü", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "aa", "\n", "KEY", "😀"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 60))) for _ in range(150)] + [None, "", "secret=token = abcdefgh", "token=x " * 700 + "f" * 40]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in secrets.find_secrets(df, [0.0] * secrets.PAIRS).collect():
        text = texts[r["doc_id"]] or ""
        assert r["base"] == base(text), text
        assert r["n_assign"] + r["n_access"] + r["n_hex"] == len([x for x in r["base"].split(",") if x])
        assert r["spans"] == r["base"] and r["n_markov"] == 0


def test_markov_models_tell_secrets_from_identifiers(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text")
    rng = random.Random(1)
    letters = secrets.ALPHABET[:62]
    mixed = ["".join(rng.choices(letters, k=32)) for _ in range(200)]
    samples = secrets.labelled_samples(docs).unionByName(spark.createDataFrame([(m, True) for m in mixed[:100]], "sample string, random boolean"))
    weights = secrets.train(samples)
    hidden = [(i, f"see {m} there") for i, m in enumerate(mixed[100:])]
    plain = [(1000 + i, w) for i, w in enumerate(["get_user_account_by_name_and_id", "thention_erealyst_andthat_ing", "the_other_reader_and_writer"])]
    found = secrets.find_secrets(spark.createDataFrame(hidden + plain, "doc_id long, text string"), weights).collect()
    assert sum(r["n_markov"] for r in found if r["doc_id"] < 1000) >= 97
    assert all(r["n_markov"] == 0 for r in found if r["doc_id"] >= 1000)
    assert {r["spans"] for r in found if r["n_markov"]} == {"markov:4:36"}
    assert secrets.train(samples.where("false")) == [0.0] * secrets.PAIRS


def test_samples_are_of_all_texts_at_full_length(spark):
    rng = random.Random(2)
    rows = [(i, " ".join("".join(rng.choices("abcdefgh_", k=12)) for _ in range(10))) for i in range(2_500)]
    rows.append((2_500, f"{'long_' * 40} token={'Q7' * 60}"))
    want = {w for _, t in rows for w in re.findall(r"[A-Za-z_][A-Za-z0-9_-]{5,}", t)}
    samples = secrets.labelled_samples(spark.createDataFrame(rows, "doc_id long, text string"))
    found = [(r["sample"], r["random"]) for r in samples.collect()]
    assert len(want) > 20_000 and len(found) == len(set(found)) and set(found) == {(w, False) for w in want} | {("Q7" * 60, True)}


def test_pairs_of_long_and_other_strings_are_all_counted(spark):
    rows = [("ab" * 100 + "é\n😀.", True), ("x" * 200_000, False)]
    weights = secrets.train(spark.createDataFrame(rows, "sample string, random boolean"))
    n, place = secrets._CLASSES, secrets.ALPHABET.index
    a, b, x, other = place("a"), place("b"), place("x"), n - 1
    assert weights[a * n + b] == pytest.approx(math.log(100.5 / (100 + n / 2) * n))
    assert weights[other * n + other] == pytest.approx(math.log(3.5 / (3 + n / 2) * n))
    assert weights[x * n + x] == pytest.approx(-math.log(199_999.5 / (199_999 + n / 2) * n))


def test_recall_of_the_model_as_trained_by_the_query(spark):
    docs = spark.read.parquet(SF_DIR.replace("0.001", "0.1") + "/documents.parquet").select("doc_id", "text")
    weights = secrets.train(secrets.labelled_samples(docs))
    rng = random.Random(7)
    for letters in (secrets.ALPHABET[:26] + "0123456789", secrets.ALPHABET[:62]):
        hidden = [(i, f"see {''.join(rng.choices(letters, k=32))} there") for i in range(300)]
        found = secrets.find_secrets(spark.createDataFrame(hidden, "doc_id long, text string"), weights)
        assert found.where("n_markov > 0").count() >= 291
    # Tokens of the corpus itself are told apart as well.
    assert secrets.find_secrets(docs.where("doc_id % 10 = 0"), weights).where("n_markov > 0").count() == 0


def test_secret_edges(spark, edges, nothing):
    assert secrets.find_secrets(edges, [0.0] * secrets.PAIRS).count() == edges.count()
    assert secrets.find_secrets(nothing, secrets.train(secrets.labelled_samples(nothing.select("doc_id", "text")))).count() == 0


def luhn(digits):
    return sum(n - 9 * (n > 9) for n in (int(d) * (1 + k % 2) for k, d in enumerate(reversed(digits)))) % 10 == 0


def fits(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 10 <= len(digits) <= 15


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a@b", "@", ".", "com", "x.y@z.org", "1", "4111 1111", "1111-", "+", "(555)", "300", "10.0", " ", "ü", "%", "-"]), max_size=25))
def test_plain_spans(parts):
    text = "".join(parts)
    want = {k: [m.span() for m in re.finditer(p, text) if fits(k, m[0])] for k, p in PII.items()}
    assert pii.plain_spans(text) == want


@pytest.mark.parametrize(
    "text, kind, span",
    [
        ("mail john.doe (at) mail [dot] example dot com now", "email", "john.doe (at) mail [dot] example dot com"),
        ("anna dot lee at example dot org", "email", "anna dot lee at example dot org"),
        ("jоhn@exаmple.com", "email", "jоhn@exаmple.com"),
        ("call plus one five five five 1 2 3 four five six seven", "phone", "plus one five five five 1 2 3 four five six seven"),
        ("4111 1111 one one one one 1111 x", "card", "4111 1111 one one one one 1111"),
        ("１９２.168.0.1", "ip", "１９２.168.0.1"),
    ],
)
def test_disguises_map_back(spark, text, kind, span):
    at = text.index(span)
    hidden = pii.hidden_spans(text, pii.plain_spans(text))
    assert hidden[kind] == [(at, at + len(span))]
    df = spark.createDataFrame([(text,)], "text string")
    assert f"{kind}:{at}:{at + len(span)}" in pii.find_personal_data(df).head()["pii"]["spans"]


@pytest.mark.parametrize("text", ["we met at the polka dot store", "look at this dot", "one or two at most", "meet at example.com"])
def test_clean_texts(text):
    assert not any(pii.hidden_spans(text, pii.plain_spans(text)).values())


def test_pii_edges(spark, edges, nothing):
    assert pii.find_personal_data(edges).where("pii.spans <> ''").count() == 0
    assert pii.find_personal_data(nothing).count() == 0


def test_held_out_quality(spark):
    folder = SF_DIR.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    train = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0)
    host, path = quality.document_sites(docs)
    judged = quality.judge(docs, train, host, path)
    held = judged.join(labels.join(train, "doc_id", "left_anti"), "doc_id")
    right = held.where(F.col("kept") == (F.col("quality") == 1)).count()
    assert held.count() > 150 and right >= 0.97 * held.count()
    assert held.where("quality = 1 AND NOT kept").count() <= 0.02 * held.count()


def test_sparse_sites_shrink(spark):
    rows = [("big", "p", 100_000)] * 400 + [("big", "q", 900_000)] * 400 + [("small", "p", 0)]
    rates = quality.site_rates(spark.createDataFrame(rows, "host string, path string, q long"))
    got = {(r["host"], r["path"]): r for r in rates.collect()}
    own = {k: (r["good"] / quality.UNIT + r["k"] * r["host_rate"]) / (r["n"] + r["k"]) for k, r in got.items()}
    assert abs(own["big", "p"] - 0.1) < 0.02 and abs(own["big", "q"] - 0.9) < 0.02
    assert own["small", "p"] > 0.1  # one bad page is not enough to condemn a site


def test_quality_edges(spark, edges, nothing):
    labels = spark.createDataFrame([(4, 1), (5, 0), (None, 1), (6, None)], "doc_id long, quality int")
    kept = quality.accepted(edges, labels)
    assert kept.columns == edges.columns
    assert quality.accepted(edges, labels.where("false")).count() == edges.count()
    assert quality.accepted(nothing, labels).count() == 0
    assert [tuple(r) for r in spark.createDataFrame([("HTTP://A.org/x/y?q",)], "u string").select(*quality.url_sites(F.col("u"))).collect()] == [("a.org", "x")]


def test_quotes(spark):
    rows = [
        (1, 0, "a", "Hello there.\nHow are you?"), (1, 1, "b", "On Monday, A wrote:\n> Hello there.\n> How are you?\n\nFine, thanks."),
        (1, 2, "a", ">> how ARE   you?\n> Fine, thanks.\n\nGood."), (1, 3, "c", "New topic"), (1, 4, "b", "> New topic\nok"), (1, 5, "x", None),
        (2, 0, "a", ""), (2, None, "a", "> zzz"), (None, 1, "b", "hi"), (None, 2, "b", "> hi\nyo"), (3, 0, "a", ">" * 20_000), (3, 1, "a", "\n" * 20_000 + "> q\nx"),
    ]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, level int")
    got = {(r["conv_id"], r["turn"]): r for r in quotes.reply_ordered(df).collect()}
    assert len(got) == len(rows)
    links = {k: (r["reply_to"], r["thread"], r["n_quotes"], r["n_linked"]) for k, r in got.items()}
    assert links[1, 1] == (0, 0, 1, 1) and links[1, 2] == (1, 0, 2, 2) and links[1, 4] == (3, 3, 1, 1)
    assert links[1, 3] == (None, 3, 0, 0) and links[None, 2] == (1, 1, 1, 1) and links[2, None] == (None, None, 1, 0)
    assert got[1, 1]["body"] == "Fine, thanks." and got[1, 2]["body"] == "Good." and got[1, 5]["body"] is None
    assert got[1, 0]["body"] == rows[0][3] and got[3, 1]["body"] == "x"
    assert quotes.reply_ordered(df.where("false")).count() == 0


def test_long_threads(spark):
    rows = [(1, 0, "a", "line 0")] + [(1, i, "a", f"> line {i - 1}\nline {i}") for i in range(1, 100)]
    got = quotes.reply_ordered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {r["thread"] for r in got} == {0} and all(r["reply_to"] == r["turn"] - 1 for r in got if r["turn"])
