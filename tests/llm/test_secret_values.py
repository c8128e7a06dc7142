"""Values in a credential context: long ones cost what their segments cost."""

from __future__ import annotations

import random
import string

from obsmill.llm import secret_scan


def spans(text):
    return [(a, b) for k, a, b in secret_scan.scan(text) if k == "guess"]


def every_segment(text):
    """The same programme over all segments, walks one by one."""
    each, best = secret_scan._pool(text), [0.0]
    known, brute = [0.0], [float("inf")]
    found = list(secret_scan.segments(text))
    for j in range(1, len(text) + 1):
        brute.append(min(brute[j - 1], known[j - 1] + (0.5 if j > 1 else 0)) + each)
        known.append(min((best[i] + c + (0.5 if i else 0) for i, e, c in found if e == j), default=float("inf")))
        best.append(min(known[j], brute[j]))
    return best[-1]


def test_length_alone_makes_no_secret():
    for n in (100, 256, 257, 300, 5000):
        for unit in ("*", "-", "ab"):
            assert spans("authorization: " + unit * n) == []
        assert spans("pwd: " + "".join("qw"[k % 2] for k in range(n))) == []
    rng = random.Random(3)
    key = "".join(rng.choice(string.ascii_letters + string.digits + "+/$") for _ in range(300))
    assert spans("authorization: " + key) == [(15, 315)]


def test_walks_and_repeats_cost_the_same_as_one_by_one():
    rng = random.Random(5)
    bits = ["qwerty", "qwqwqw", "asdfgfdsa", "zxcv", "1q2w", "aaaa", "abab", "xyzxyz", "pass", "2020", "K", "é", "7", "poiuytrewq"]
    for _ in range(300):
        t = "".join(rng.choice(bits) for _ in range(rng.randrange(1, 8)))
        assert abs(secret_scan.guess_cost(t) - every_segment(t)) < 1e-9, t


def test_credential_words_inside_identifiers():
    value = "f8$kd!92kd_Zq0@x"
    for name in ("AWS_SECRET_ACCESS_KEY", "SECRET_KEY", "DB_PASSWORD", "db_pwd", "STRIPE_SECRET_KEY", "PGPASSWORD", "dbPassword", "userPwd", "authHeader", "spring.datasource.password", "password_1", "clientSecret", "pwd", "x-auth"):
        for sign in ("=", ": ", '" : "', " = '"):
            assert spans(f"a {name}{sign}{value} b") == [(2 + len(name + sign), 2 + len(name + sign + value))], (name, sign)
    for name in ("author", "compass", "secretary", "passage", "bypass", "forbearer"):
        assert spans(f"{name}: {value}") == [], name
    assert spans("url=http://h/?db_password=" + value) == [(26, 42)]
    assert spans("DB_PASSWORD=changeme") == []


def test_long_identifiers_take_linear_time():
    assert spans("token" * 200_000 + " no sign") == []
