import hashlib
import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from citeframe.llm import disclosure, queries

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def plain_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                "card": 12 <= len(digits) <= 19 and _luhn(digits), "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((m.start(), list(PATTERNS).index(kind), kind, m.end()))
    return [(kind, start, end) for start, _, kind, end in sorted(out)]


def plain_added(texts, near=disclosure.NEAR):
    """Disclosing terms by counting all places in all texts, and their places in the distinct texts."""
    n_term, n_form, n_near, form_near, seen = Counter(), Counter(), Counter(), Counter(), defaultdict(set)
    words_of, close_of = {}, defaultdict(set)

    def form(w):
        return w[: (len(w) + 1) // 2] + "*"

    for text in texts:
        spans = plain_spans(text)
        words = [(m[0].lower(), m.start(), m.end()) for m in re.finditer(r"\w+", text)]
        words = [w for w in words if not any(w[1] < e and s < w[2] for _, s, e in spans)]
        words_of[text] = words
        for w, *_ in words:
            n_term[w] += 1
            n_form[form(w)] += 1
        near_places = defaultdict(set)
        for kind, start, end in spans:
            name = disclosure.entity(kind, text[start:end])
            k = sum(w[1] < start for w in words)
            window = range(max(0, k - near), min(len(words), k + near))
            near_places[name] |= set(window)
            for i in window:
                seen[name, words[i][0]].add(tuple(words[j][0] for j in window))
                close_of[text].add((name, words[i][0]))
        for name, places in near_places.items():
            for i in places:
                n_near[name, words[i][0]] += 1
                form_near[name, form(words[i][0])] += 1
    told = {}
    for (name, w), n in n_near.items():
        if len(seen[name, w]) > 1 and n_term[w] <= 2 * n:
            told[name, w] = "general" if n_form[form(w)] > 2 * form_near[name, form(w)] else "removed"
    out = {}
    for text in set(texts):
        kinds = defaultdict(set)
        for pair in close_of[text]:
            if pair in told:
                kinds[pair[1]].add(told[pair])
        out[text] = sorted(("removed" if "removed" in kinds[w] else "general", s, e) for w, s, e in words_of[text] if w in kinds)
    return out, told


HARD = [
    "a@b.c", "x.y@@z.de", "one@two.three_four@five.six", "a@b.c.d.@e.f", "me@host", "é@x.yz", "a.b@c.d@e.f",
    "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "0001.002.03.4", "1.2.3.", "9" * 5000 + ".1.1.1", "1.22.333.4444",
    "4111 1111 1111 1111", "4111-1111-1111-1111 0", "4111  1111", "41111111111111112", "0" * 12, "0" * 20,
    "+1 (555) 123-4567", "+12-", "++491234567890 ", "+1 23", "+4 444 444 444 444 444 444 44", "+1(2).3-4 5 6 7 8 9.",
    "", "abc", "x" * 200_000, "1 " * 50_000,
]


def test_base_spans_equal_plain_patterns():
    rng = random.Random(2)
    for _ in range(4000):
        text = "".join(rng.choice("a1.@+- ()4é%") for _ in range(rng.randint(0, 40)))
        assert disclosure.base_spans(text) == plain_spans(text), text
    for text in HARD[:-2]:
        if len(text) < 5000:
            assert disclosure.base_spans(text) == plain_spans(text), text
    assert disclosure.base_spans("9" * 5000 + ".1.1.1 x") == []
    for text in HARD[-2:]:
        assert disclosure.base_spans(text * 5) == []


def _corpus(rng):
    plain = [f"word{i}" for i in range(60)]
    texts = []
    for i in range(60):
        words = [rng.choice(plain) for _ in range(rng.randint(5, 60))]
        if i % 3 == 0:
            who = rng.randint(0, 3)
            at = rng.randint(0, len(words))
            words[at:at] = ["Director", f"Mc{who}Allister", f"user{who}@Mail.example.com", f"secret{who}{rng.randint(0, 1)}"]
        if i % 10 == 0:
            words.insert(rng.randint(0, len(words)), "+1 (555) 123-4567")
        texts.append(" ".join(words))
    return [*texts, texts[0], texts[0], None, "", "mcallister alone, word1", "w" * 100 + " a@b.c " + "w" * 100 + " x a@b.c"]


def test_spans_equal_brute_force(spark):
    texts = _corpus(random.Random(4))
    rows = [(i if i % 7 else None, t, "clash", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, spans string, added int").repartition(5)
    got = disclosure.find_spans(spark, docs.withColumn("row", F.coalesce("text", F.lit(""))))
    want, told = plain_added([t or "" for t in texts])
    assert len({t for _, t in told}) > 5 and set(told.values()) == {"general", "removed"}
    rows = got.collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert [(s["kind"], s["start"], s["end"]) for s in r["base"]] == plain_spans(r["row"])
        assert sorted((s["kind"], s["start"], s["end"]) for s in r["added"]) == want[r["row"]]
    terms = disclosure.disclosing_terms(disclosure.read_corpus(spark, docs)).collect()
    assert {(r["entity"], r["term"]): "general" if r["general"] else "removed" for r in terms} == told
    assert all(0 <= r["unknown_bits"] <= disclosure.UNKNOWN_BITS for r in terms)


def test_sanitised_texts_disclose_nothing(spark):
    said = ["Ring Zebulon today at zeb@x.org now", "or Zebulon said zeb@x.org again", "nothing today at all now or again said ring", None]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(said)], "doc_id int, text string")
    done = {r["doc_id"]: r["text"] for r in disclosure.sanitise(spark, docs).collect()}
    assert done[0] == "Ring [REMOVED] today at [EMAIL] now"
    assert done[1] == "or [REMOVED] said [EMAIL] again"
    assert (done[2], done[3]) == (said[2], None)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert disclosure.find_spans(spark, docs).collect() == []
    assert disclosure.sanitise(spark, docs).collect() == []


def test_query(spark, sf):
    texts = {r[0]: r[1] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    added, _ = plain_added(list(texts.values()))
    for r in queries.op11_personal_data(spark, sf).collect():
        base = plain_spans(texts[r["doc_id"]])
        assert hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in base).encode()).hexdigest() == r["base_sha256"]
        assert Counter(k for k, *_ in base) == Counter({k: r[f"n_{k}"] for k in PATTERNS if r[f"n_{k}"]})
        both = sorted([*base, *added[texts[r["doc_id"]]]], key=lambda s: (s[1], s[0]))
        assert sorted(r["spans"].split(",")) == sorted(f"{k}:{s}:{e}" for k, s, e in both) or not both
