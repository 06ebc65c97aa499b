"""Personal data by plain patterns, and by context where no pattern knows it."""

import hashlib
import random
import re

from tessella.llm import common, pii

KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def _brute(t):
    out = []
    for n, (k, p) in enumerate(KINDS.items()):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            if k == "ip" and any(int(x) > 255 for x in m[0].split(".")) or k == "card" and not (14 <= len(d) <= 19 and _luhn(d)) or k == "phone" and not 10 <= len(d) <= 15:
                continue
            out.append((m.start(), n, m.end(), k))
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(out))


def test_base_spans_by_brute_force(spark):
    rng = random.Random(3)
    pool = list("ab@.._%+-0123456789 () 🙂é\n") + ["4111111111111111", "a@b.c", "+1 (614) 555-8001", "1.2.3.4", "255.256.1.1", "0001.2.3.4"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 60))) for _ in range(1500)] + [None, "", "a" * 50000 + "@", "1." * 20000, "a@" + "b." * 20000 + "c", "7" * 30000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 AS row", "2 AS kind", "3 AS found", "4 AS spans")
    got = {r["doc_id"]: r for r in pii.digests(pii.find(docs)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = _brute(t or "")
        assert got[i]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest(), repr(t)[:80]
        assert got[i]["n_email"] == want.count("email:")
    assert pii.find(docs.limit(0)).count() == 0


def test_context_finds_unseen_identifiers(spark):
    known = ["joe@x.com", "amy@y.org", "bob@z.net", "10.1.2.3"]
    rows = [(i, f"please quote member id: {x} thanks") for i, x in enumerate([*known, "ZX81-4432", "(77-1234-K),"])] + [(50, "we met in 1999 again"), (51, None), (51, "plain words only")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.digests(pii.find(docs)).collect()}
    assert got[4] == "other:24:33" and got[5] == "other:25:34"
    assert got[50] == "" and got[0] == "email:24:33"
    text = {r["doc_id"]: r["text"] for r in pii.mask(docs).collect()}
    assert text[4] == "please quote member id: [OTHER] thanks" and text[0] == "please quote member id: [EMAIL] thanks" and text[50] == "we met in 1999 again"
    assert pii.mask(docs).columns == docs.columns


def test_discovered_identifiers_support_new_patterns(spark):
    known, unseen = ["joe@x.com", "amy@y.org", "bob@z.net", "10.1.2.3"], ["ZX81-4432", "77-1234-K", "QQ-90817"]
    texts = [f"please quote member id: {x} thanks" for x in known * 2 + unseen]
    texts += [f"the badge no: {x} expires soon" for x in [*unseen, "KL-55512"]]  # no seed stands here
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.digests(pii.find(docs, min_confidence=0.7)).collect()}
    assert got[len(texts) - 1] == "other:14:22"


def test_any_words_make_a_pattern(spark):
    known = [f"u{i}@x{i}.com" for i in range(8)]
    texts = [f"please reach me at {x} today" for x in [*known, "ZX81-4432"]] + [f"{w} seen in {1990 + i} by all" for i, w in enumerate(["cat", "dog", "owl", *known])]
    texts += [f"passeport {x}" for x in [*known, "X1234567"]]  # one word, nothing after it
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    got = [r["spans"] for r in sorted(pii.digests(pii.find(docs)).collect(), key=lambda r: r["doc_id"])]
    assert got[8] == "other:19:28" and got[-1] == "other:10:18"
    assert sum("other" in x for x in got) == 2  # years stand in contexts of their own


def test_phones_and_spaced_cards_seed_contexts(spark):
    phones = [f"+1 (614) 555-80{i}" for i in range(10, 18)]
    cards = ["4111 1111 1111 1111", "5500 0000 0000 0004", "4012 8888 8888 1881", "6011 0000 0000 0004", "3530 1113 3330 0000", "5555 5555 5555 4444"]
    texts = [f"Office phone: {x}, call now" for x in [*phones, "020-7946-0123"]] + [f"charged to card ({x}) yesterday" for x in [*cards, "4111-22-9"]]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    got = [r["spans"] for r in sorted(pii.digests(pii.find(docs)).collect(), key=lambda r: r["doc_id"])]
    assert got[8] == "other:14:27" and got[-1] == "other:17:26"
    assert all("other" not in x for x in [*got[:8], *got[9:-1]])


def test_held_out_identifiers_in_four_languages(spark):
    rng = random.Random(11)
    frames = ["my account number is {} thank you", "die Kundennummer ist {} danke schön", "le numéro client est {} merci bien", "mi número de socio es {} por favor", "write to {} about it", f"the {'x' * 120}: {{}} ends", "member v2 {} renewed"]
    words = "alpha bravo der die haus maison rue calle casa with from the and und mais pero".split()

    def other():
        return "".join(rng.choice("ABCDEFGHKLMNPQ") for _ in range(2)) + "-" + "".join(rng.choice("0123456789") for _ in range(6))

    texts, want = [], []
    for f in frames:
        for k in range(36):  # a dozen seeds, and identifiers of a form that no fixed pattern knows
            x = f"u{rng.randrange(10**6)}@mail{k}.example.org" if k < 12 else other()
            t = f.format(x)
            texts.append(t)
            want.append(f"other:{t.index(x)}:{t.index(x) + len(x)}" if k >= 12 else None)
    for _ in range(300):  # numbers and years that nothing introduces
        t = " ".join(rng.choice(words) for _ in range(6)) + f" {rng.randrange(1900, 2030)} " + " ".join(rng.choice(words) for _ in range(6))
        texts.append(t)
        want.append("")
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.digests(pii.find(docs)).collect()}
    hidden = [i for i, w in enumerate(want) if w]
    caught = sum(got[i] == want[i] for i in hidden)
    false = sum("other" in got[i] for i, w in enumerate(want) if not w)
    assert caught >= 0.9 * len(hidden) and false <= 0.02 * caught, (caught, len(hidden), false)


def test_function_words_and_years_tell_nothing(spark):
    rng = random.Random(8)

    def card(good):
        while True:
            d = "".join(rng.choice("0123456789") for _ in range(16))
            if (sum(int(c) if i % 2 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d)) % 10 == 0) == good:
                return d

    texts = [f"in {card(True)} on" for _ in range(12)] + [f"he was there in {1900 + i}" for i in range(40)] + [f"born in {1950 + i} on" for i in range(3)]
    words = "anor onnd the of in by de that here with some wine road hill".split()
    for k in range(300):  # prose with valid and invalid numbers after any word, most of all function words
        t = [rng.choice(words) for _ in range(40)]
        t.insert(rng.randrange(40), card(k % 3 > 0))
        texts.append(" ".join(t))
    texts += [f'token = "{rng.randrange(16**39, 16**40):x}" end' for _ in range(20)]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.digests(pii.find(docs)).collect()}
    assert sorted(i for i, x in got.items() if "other" in x) == [i for i in sorted(got) if i >= len(texts) - 20]
    masked = {r["doc_id"]: r["text"] for r in pii.mask(docs).collect()}
    assert masked[12] == texts[12] and masked[len(texts) - 1] == "token = [OTHER] end"


def _scores(found, rounds, min_seeds, least, half):
    """discover() over (pattern, side, token, prior) in plain Python."""
    prior = {}
    for _, _, t, p in found:
        prior[t] = max(p, prior.get(t, 0))
    graph = {(a, b, t) for a, b, t, _ in found}
    score = {t: p for t, p in prior.items() if p}
    for _ in range(rounds):
        of = {}
        for a, _, t in graph:
            of.setdefault(a, set()).add(t)
        counting = {a for a, ts in of.items() if sum(score.get(t, 0) >= least or prior[t] > 0 for t in ts) >= min_seeds}
        mine = {}
        for a, _, t in graph:
            mine.setdefault(t, set()).add((a, _))
        stray = {t: 1 - sum(a in counting for a, _ in x) / len(x) for t, x in mine.items()}
        mere = {t for t, p in prior.items() if p < 1 and not re.search(r"[^\W\d_]|@", t)}
        pro = {a: sum(0 if t in mere else score.get(t, 0) for t in of[a]) for a in counting}
        trust = {a: pro[a] / (pro[a] + sum(1 if t in mere else (1 - score.get(t, 0)) * stray[t] for t in of[a]) + 1) for a in counting}
        best = {}
        for a, b, t in graph:
            if trust.get(a, 0) >= least / 2:
                best[t, b] = max(trust[a], best.get((t, b), 0))
        now = {}
        for t, p in prior.items():
            right = 1 - p
            for b in ("one", "both"):
                right *= 1 - min(best.get((t, b), 0), 0.999)
            now[t] = 1.0 if p == 1 else 1 - right
        done = abs(sum(now.values()) - sum(score.values())) <= 0.001 * sum(now.values())
        score = now
        if done:
            break
    return {t: s for t, s in score.items() if s >= least and prior[t] < 1}


def test_scores_by_brute_force(spark):
    rng = random.Random(12)
    words = ["id:", "is", "key", "=", "the", "no"]
    texts = []
    for _ in range(400):
        x = rng.choice([f"a{rng.randrange(40)}@b.org", f"K-{rng.randrange(1000, 1040)}", f"{rng.randrange(16**20, 16**21):x}", str(rng.randrange(1990, 2020))])
        texts.append(" ".join([rng.choice(words), rng.choice(words), x, rng.choice(words), rng.choice(words)]))
    _, finds = pii.scan(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string"))
    found = pii.occurrences(finds)
    graph = [tuple(r) for r in pii.edges(found).collect()]
    for least in (0.3, 0.5, 0.8):
        got = {r["token"]: r["score"] for r in pii.discover(found, min_confidence=least).collect()}
        want = _scores(graph, pii.ROUNDS, pii.MIN_SEEDS, least, pii.HALF_SEED)
        assert set(got) == set(want) and all(abs(got[t] - want[t]) < 1e-6 for t in want)
    assert want or _scores(graph, pii.ROUNDS, pii.MIN_SEEDS, 0.3, pii.HALF_SEED)


def test_rounds_ask_little_of_the_driver(spark):
    """Every exchange is a job under adaptive execution, and each costs the driver's memory: 64 jobs in all for six rounds at most."""
    rng = random.Random(12)
    texts = [" ".join([rng.choice(["id:", "is", "="]), rng.choice([f"a{rng.randrange(40)}@b.org", f"K-{rng.randrange(1000, 1040)}"]), rng.choice(["the", "no"])]) for _ in range(200)]
    _, finds = pii.scan(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string"))
    found = common.materialize(pii.occurrences(finds), "found")
    spark.sparkContext.setJobGroup("rounds", "")
    try:
        pii.discover(found).collect()
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("rounds")) <= 64
        assert pii.discover(found.limit(0)).count() == 0
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_keys_support_each_other_by_their_context(spark):
    rng = random.Random(13)
    keys = [f"{rng.randrange(16**39, 16**40):x}" for _ in range(40)]
    texts = [f'some word here token = "{k}" and more' for k in keys] + [f"{a} {rng.randrange(16**39, 16**40):x} {b}" for a, b in (("north", "south"), ("up", "down"), ("red", "blue"))] + ['the token = "7788-ZQ" too']
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.digests(pii.find(docs)).collect()}
    assert all(got[i] == "other:24:64" for i in range(40))
    assert all(got[i] == "" for i in range(40, 43)) and got[43] == "other:13:20"


def test_mask_of_odd_rows(spark):
    rows = [(1, None, 5), (1, "", 5), (2, "x" * 200_000 + " a@b.cd", 6), (None, "mail a@b.cd", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tess_id int").selectExpr("*", "1 AS tess_tokens", "2 AS row", "3 AS token")
    got = {(r["doc_id"], len(r["text"] or "")) for r in pii.mask(docs).collect()}
    assert got == {(1, 0), (2, 200_008), (None, 12)}
    assert pii.mask(docs.limit(0)).count() == 0 and pii.mask(docs).columns == docs.columns


def test_mask_replaces_the_spans_of_the_text_as_it_was(spark):
    rng = random.Random(6)
    pool = list("ab@.+- ()é🙂0123456789") + ["4111111111111111", "a@b.c", "+1 (614) 555-8001", "1.2.3.4", "+33.1.42.68.53.00"]
    texts = ["Fax +33.1.42.68.53.00 now", "x1.2.3.4@b.c", "", None, "none"] + ["".join(rng.choice(pool) for _ in range(rng.randint(0, 40))) for _ in range(300)]

    def want(t):
        spans = sorted((int(s), int(e), k) for k, s, e in (x.split(":") for x in _brute(t).split(",") if x))
        out, at, i = "", 0, 0
        while i < len(spans):
            group, end = [spans[i]], spans[i][1]
            while (i := i + 1) < len(spans) and spans[i][0] < end:
                group.append(spans[i])
                end = max(end, spans[i][1])
            longest = max(e - s for s, e, _ in group)
            names = {k.upper() for s, e, k in group if e - s == longest}
            out += t[at : group[0][0]] + f"[{'|'.join(sorted(names))}]"
            at = end
        return out + t[at:]

    rows = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in rows.select("doc_id", pii._replaced(rows["text"]).alias("text")).collect()}
    assert got[0] == "Fax [PHONE] now" and got[3] is None
    masked = {r["doc_id"]: r["text"] for r in pii.mask(rows.limit(5)).collect()}
    assert masked[0] == "Fax [PHONE] now" and masked[3] is None and masked[4] == "none"
    for i, t in enumerate(texts):
        if t is not None and "|" not in (w := want(t)):
            assert got[i] == w, repr(t)


def test_mask_of_rows_without_ids(spark):
    known = ["joe@x.com", "amy@y.org", "bob@z.net", "10.1.2.3"]
    texts = [f"please quote member id: {x} thanks" for x in [*known, "ZX81-4432", "ZX81-4432", "QQ-90817"]] + [None, "", "plain words"]
    docs = spark.createDataFrame([(None, t, i) for i, t in enumerate(texts)], "doc_id string, text string, tess_of int")
    got = {r["tess_of"]: r["text"] for r in pii.mask(docs).collect()}
    assert len(got) == len(texts) and pii.mask(docs).columns == docs.columns
    assert {got[i] for i in range(4)} == {"please quote member id: [EMAIL] thanks", "please quote member id: [IP] thanks"}
    assert {got[i] for i in (4, 5, 6)} == {"please quote member id: [OTHER] thanks"}
    assert [got[i] for i in (7, 8, 9)] == [None, "", "plain words"]
