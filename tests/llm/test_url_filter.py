import collections
import hashlib
import math
import re
import zlib

import numpy as np

from marlstone.llm.url_filter import RULES, calibrated, filter_urls


def parts(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    return (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")


def rule(host, path):
    fit = [(len(h) + len(p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[1:] if fit else (None, None)


URLS = [
    None, "", "no scheme.com/x", "http://", "https://A.example.COM/en/1?x#y", "http://www.example.com/en/2", "http://example.com/fr/", "http://com/a", "http://xcom/a",
    "ftp://x.net/es/1", "ftp://x.net/ES/1", "http://net", "http://a.net?b=/fr/", "x://y://z.com/", "http://é.net/fr/ü", "http://a.org/en/" + "long/" * 20_000,
]


def test_rules_and_null(spark):
    rows = [(i, u, "<p>", "com/", "allow") for i, u in enumerate(URLS * 2)]
    table = spark.createDataFrame(rows, "page_id bigint, url string, html string, rule string, verdict string")
    got = filter_urls(table).collect()
    assert len(got) == len(rows)
    for r in got:
        host, path = parts(rows[r.page_id][1])
        name, verdict = rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, name)
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")
        if not host:
            assert r.verdict == "block"
    assert filter_urls(table.where("false")).count() == 0


def test_models_tell_kinds_apart(spark):
    rows = [(i, f"http://{'good' if i % 2 else 'casino'}{i % 37}.{'com' if i % 2 else 'net'}/{'fr/' if i % 2 == 0 else ''}{'garden' if i % 2 else 'jackpot'}{zlib.crc32(b'%d' % i) % 99}") for i in range(600)]
    rows += [(1000, "http://good5.org/garden7"), (1001, "http://casino9.org/jackpot8")]
    got = {r.page_id: r.verdict for r in filter_urls(spark.createDataFrame(rows, "page_id bigint, url string")).collect()}
    assert got[1000] == "allow" and got[1001] == "block"


def test_calibration_without_one_kind():
    none = np.array([], int)
    assert calibrated(np.array([], bool), none, none, 10) == float("-inf")
    assert calibrated(np.array([True]), np.array([3]), np.array([1]), 10) == float("inf")


def test_every_context_has_its_own_count(spark):
    # More different contexts than 65,536: each must be counted by itself.
    name = lambda i: "".join(chr(97 + b % 26) for b in hashlib.sha256(b"%d" % i).digest())
    urls = [f"http://{name(i)}.{'com' if i % 2 else 'net'}/{'' if i % 2 else 'es/'}{name(i + 9999)}" for i in range(2000)] + ["http://Q.org/zz"]
    urls += urls[:40]
    got = filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string"), chunk_bytes=20_000).collect()
    assert len(got) == len(urls)
    held = {r.s: r.h for r in spark.createDataFrame([(r.host + r.path,) for r in got], "s string").selectExpr("s", "pmod(xxhash64(cast(s as binary)), 5) = 0 h").collect()}
    seen, after = collections.Counter(), collections.Counter()
    for r in got:
        if r.rule and not held[r.host + r.path]:
            for gram in grams(r.host + r.path):
                for k in range(6):
                    after[r.verdict, gram[5 - k :]] += 1
                    seen[r.verdict, gram[5 - k : 5]] += 1
    assert len({g for _, g in seen}) > 65_536
    for r in got[:200] + got[-50:]:
        score = 0
        for gram in grams(r.host + r.path):
            for kind, sign in (("allow", 1), ("block", -1)):
                chance = 1 / 256
                for k in range(6):
                    chance = (after[kind, gram[5 - k :]] + 4 * chance) / (seen[kind, gram[5 - k : 5]] + 4)
                score += sign * math.log(chance)
        assert abs(r.score - score / (len(r.host + r.path) + 1)) < 1e-9


def grams(text):
    text = b"\x02" * 5 + text.encode() + b"\x03"
    return [text[i : i + 6] for i in range(len(text) - 5)]
