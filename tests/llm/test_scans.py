"""Secrets, personal data and fingerprints against brute force."""

import hashlib
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import EXTRA, ODD, frame
from tidewatch.llm import fingerprints, pii, queries, secrets


def noise(r, pieces, n):
    return "".join(r.choice(pieces) for _ in range(n))


def brute_secrets(t):
    found = [("assign", *m.span()) for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 6]
    found += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    found += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(found, key=lambda s: (s[1], secrets.KINDS.index(s[0])))


def test_secret_base():
    r = random.Random(4)
    pieces = ["password", "PassWd", "token", "api_key", "apikey", '"', "'", " ", ":", "=", "abc", "0f" * 13, "AKIA", "ABCDEFGHIJKLMNOPQ", "Z", "é", "K", "ſecret", "deadbeef" * 3, "-"]
    for _ in range(3000):
        t = noise(r, pieces, r.randint(1, 14))
        assert secrets.base_spans(t) == brute_secrets(t), t


def test_novelty():
    n = secrets.Novelty()
    key = "Zk3x9QpLw82mVbT7rYc4"
    base, spans, most = secrets.scan(f"auth_session: {key} and more", n)
    assert base == [] and spans == [("novel", 14, 34)] and most > 0.75
    for plain in ("the private key_identifier_of_configuration_2 is", "auth value AAAAAAAAAAAAAAAAAAAAAAAA1111", f"some plain words then {key}", "key supercalifragilisticexpialidocious"):
        assert secrets.scan(plain, n)[1] == [], plain
    assert n.ratio("x", "AAAAAAAAAAAAAAAAAAAAAAAA1") < n.ratio("x", "Zk3x9QpLw82mVbT7rYc4hG5jK")
    twice = f"first {key} then auth "
    assert n.marginal(twice, key) < n.marginal("first then auth ", key)


def test_novelty_of_named_and_plain_values():
    """The key's name may be within the run, and a value may be letters of both cases or digits alone."""
    n, key = secrets.Novelty(), "Zk3x9QpLw82mVbT7rYc4"
    found = lambda t: [t[a:b] for k, a, b in secrets.scan(t, n)[1] if k == "novel"]
    for before in ("AWS_SECRET_ACCESS_KEY=", "http://host.example/page?access_key=", "see /srv/session/", "auth_", "auth_session: ", "X=1&sign="):
        for value in (key, key + "==", key + "/hG5jKs2Wd8Xn"):
            assert found(f"{before}{value} and more") == [value], before
    assert found("Bearer QmXkTzPwLsVhRjYcNdFgBtWq") == ["QmXkTzPwLsVhRjYcNdFgBtWq"]
    assert found("login code 8302847561029384 here") == ["8302847561029384"]
    for plain in ("auth 0000000000000000000", "key authenticationTokenProviderFactory", "key getUserSessionFromRequestHeader", "ACCESS_KEY_IDENTIFIER=configuration_identifier_2", f"some plain words then name={key}"):
        assert found(plain) == [], plain


def brute_pii(t):
    found = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    found += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[ -]", "", m[0])
        if 13 <= len(d) <= 19 and pii.luhn(d):
            found.append(("card", *m.span()))
    found += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.findall("[0-9]", m[0])) <= 15]
    return found


def test_pii_base():
    r = random.Random(6)
    pieces = ["a", "b.c", "@", ".", "com", "1", "23", "255", "256", "4111111111111111", " ", "-", "+", "(", ")", "555", "é", "\n", "%", "007", "+1"]
    for _ in range(4000):
        t = noise(r, pieces, r.randint(1, 20))
        assert pii.base_spans(t) == brute_pii(t), t


def test_crf():
    model = pii.default_model()
    held = pii.default_table(200, seed=1234)
    pairs = [(x, y) for (tokens, labels), path in zip(held, model.decode([pii.features(t) for t, _ in held]), strict=True) for x, y in zip(path, labels, strict=True)]
    assert sum(pii.LABELS[x] == y for x, y in pairs) / len(pairs) > 0.97
    text = "call me at (555) 123-4567 today or mail bob.7 (at) example.com now"
    (added,) = pii.added_spans([text], [pii.base_spans(text)], model)
    assert [(k, text[a:b]) for k, a, b in added] == [("phone", "(555) 123-4567"), ("email", "bob.7 (at) example.com")]
    for clean in ("plain words only, and no 12 numbers that matter", "300.1.2.3 and 4111111111111112", "Licensed under CC BY-NC 4.0.", ""):
        assert pii.added_spans([clean], [[]], model) == [[]], clean


PROSE = "the river of our house and green letters were never under that light where people might wait for another point of view in a small town at night".split()


def planted(value, r, before=""):
    """value within random prose, and its place."""
    head = " ".join(r.choice(PROSE) for _ in range(r.randint(12, 20))) + " " + before
    return head + value + " " + " ".join(r.choice(PROSE) for _ in range(r.randint(8, 14))), len(head)


def test_pii_recall():
    """Forms that the patterns don't know, 300 of each; prose with numbers that are none."""
    r = random.Random(11)
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    name = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(3, 9)))
    forms = {
        "ddd-ddd-dddd": lambda: f"{d(3)}-{d(3)}-{d(4)}", "(ddd) ddd-dddd": lambda: f"({d(3)}) {d(3)}-{d(4)}", "ddd.ddd.dddd": lambda: f"{d(3)}.{d(3)}.{d(4)}",
        "0ddd ddd dddd": lambda: f"0{d(3)} {d(3)} {d(4)}", "0dd dddd dddd": lambda: f"0{d(2)} {d(4)} {d(4)}", "0dddd dddddd": lambda: f"0{d(4)} {d(6)}",
        "(at)": lambda: f"{name()} (at) {name()}.com", "at dot": lambda: f"{name()} at {name()} dot com", "at dot dot": lambda: f"{name()} at {name()} dot {name()} dot org", "[at] [dot]": lambda: f"{name()} [at] {name()} [dot] net",
    }
    model, recall = pii.default_model(), {}
    for form, make in forms.items():
        values = [make() for _ in range(300)]
        texts, places = zip(*(planted(v, r, r.choice(("", "", "call "))) for v in values), strict=True)
        found = pii.added_spans(list(texts), [pii.base_spans(t) for t in texts], model)
        recall[form] = sum((p, p + len(v)) in {(a, b) for _, a, b in f} for f, p, v in zip(found, places, values, strict=True)) / 300
    print(recall)
    assert min(recall.values()) >= 0.9, recall
    clean = [planted(r.choice((d(3), d(6), f"{d(2)}:{d(2)}", f"{d(4)}-{d(2)}-{d(2)}", f"{d(1)}.{d(2)}", f"{d(2)} {d(3)}", "dot", f"{d(1)}.{d(1)}.{d(2)}", f"at the dot {d(2)}")), r)[0] for _ in range(1000)]
    wrong = sum(map(len, pii.added_spans(clean, [pii.base_spans(t) for t in clean], model)))
    print("wrong", wrong)
    assert wrong <= 20


def test_secret_recall():
    """Random values after a sensitive word by kind and length, 300 of each; words and identifiers in such places are none."""
    r, n, recall = random.Random(12), secrets.Novelty(), {}
    low = "abcdefghijklmnopqrstuvwxyz"
    for kind, signs in {"all": low + low.upper() + "0123456789", "both cases": low + low.upper(), "digits": "0123456789", "lower case and digits": low + "0123456789"}.items():
        for size in (12, 16, 20, 32):
            hits = 0
            for _ in range(300):
                value = "".join(r.choice(signs) for _ in range(size))
                text, at = planted(value, r, "Authorization: Bearer ")
                hits += any(a <= at and b >= at + size for _, a, b in secrets.scan(text, n)[1])
            recall[kind, size] = hits / 300
    print(recall)
    assert min(v for (kind, _), v in recall.items() if kind != "both cases") >= 0.9 and min(recall.values()) >= 0.8, recall
    joined = [planted("_".join(r.choice(secrets.IDENTIFIERS.split()) for _ in range(3)), r, "Authorization: Bearer ")[0] for _ in range(2000)]
    wrong = sum(secrets.scan(t, n)[1] != [] for t in joined)
    print("wrong", wrong)
    assert wrong <= 20


def test_long_runs_take_linear_time():
    def seconds(text):
        began = time.perf_counter()
        spans = pii.base_spans(text)
        pii.added_spans([text], [spans], pii.default_model())
        return time.perf_counter() - began

    for make in (lambda n: "1" * n + ".1", lambda n: "a" * n + "@", lambda n: "a@" * (n // 2), lambda n: "1." * (n // 2), lambda n: "a" * n + "1" + "b" * 200 + "2" + "c" * n):
        seconds(make(1000))
        assert seconds(make(400_000)) < 5
    text = "x" * 20_000 + ".bob@ex.com"
    assert pii.base_spans(text) == [("email", 0, len(text))]


def test_viterbi_is_best_path():
    import itertools

    model = pii.fit(pii.default_table(40), steps=15)
    tokens = "mail a.b (at) c.de".split()
    seq = pii.features(tokens)
    e, _ = model.emissions([seq])
    score = lambda p: model.start[p[0]] + sum(e[0, t, y] for t, y in enumerate(p)) + sum(model.trans[a, b] for a, b in itertools.pairwise(p))
    assert tuple(model.decode([seq, seq[:2]])[0]) == max(itertools.product(range(5), repeat=4), key=score)


@pytest.mark.parametrize(("find", "base", "kinds"), [(secrets.find_secrets, secrets.base_spans, 3), (pii.find_pii, pii.base_spans, 4)])
def test_scans_on_odd_rows(spark, find, base, kinds):
    df = frame(spark, extra=EXTRA)
    got = find(df)
    want = sorted((r["doc_id"] if r["doc_id"] is not None else -1, base(r["text"] or "")) for r in df.collect())
    assert sorted((r["id"] if r["id"] is not None else -1, [tuple(s) for s in r["base"]]) for r in got.collect()) == want
    digest = queries._span_digest(got, ("assign", "access", "hex") if kinds == 3 else pii.KINDS)
    for r in digest.collect():
        spans = dict(want).get(r["doc_id"] if r["doc_id"] is not None else -1)
        if r["doc_id"] is not None:
            assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
    assert find(frame(spark, []).limit(0)).count() == 0


def jaccard(a, b):
    keys = set(a) | set(b)
    return sum(min(a[k], b[k]) for k in keys) / max(1, sum(max(a[k], b[k]) for k in keys))


def test_likeness_is_generalised_jaccard():
    r = random.Random(8)
    s = fingerprints.Sampler(samples=1024, kept=50)
    errors = []
    for _ in range(40):
        words = [noise(r, "abcdef", 3) for _ in range(30)]
        a, b = (fingerprints.bag_of(" ".join(r.choice(words[: r.randint(3, 30)]) for _ in range(r.randint(1, 200)))) for _ in range(2))
        x, y = s.signatures([a, b])
        errors.append(fingerprints.likeness(x, y) - jaccard(a, b))
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.03


def test_signature_does_not_depend_on_the_batch():
    bags = [fingerprints.bag_of(t) for t in ("a b c a", "b c d " * 50, "", "e " * 9 + "a")]
    one, few = fingerprints.Sampler(), fingerprints.Sampler(chunk=1, kept=2)
    alone = [fingerprints.Sampler().signatures([b])[0] for b in bags]
    assert one.signatures(bags) == few.signatures(bags) == alone
    assert few.signatures(bags[::-1]) == alone[::-1]


def test_fingerprints_with_next(spark):
    df = frame(spark)
    got = {r["id"]: r for r in fingerprints.fingerprint_with_next(df).collect()}
    texts = [t or "" for t in ODD]
    s = fingerprints.Sampler()
    for i, t in enumerate(texts):
        nxt = texts[(i + 1) % len(texts)]
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        a, b, c = s.signatures([fingerprints.bag_of(x) for x in (t, edited, nxt)])
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest(), a, b)
        assert (r["near_edited"], r["near_next"]) == (fingerprints.likeness(a, b), fingerprints.likeness(a, c))
    assert fingerprints.fingerprint_with_next(frame(spark, extra=EXTRA)).count() == len(ODD) + len(EXTRA)
    assert fingerprints.fingerprint_with_next(frame(spark, []).limit(0)).count() == 0
    (single,) = fingerprints.fingerprint_with_next(frame(spark, ["a b c d"])).collect()
    assert single["near_next"] == 1.0
    prints = {r["id"]: r["fingerprint"] for r in fingerprints.fingerprint(df).collect()}
    assert prints == {i: got[i]["fingerprint"] for i in prints} and F is not None
