import datetime
import random

from edges import by_row

from plumbline.llm import fixity, lists


def replica(spark, rows):
    return spark.createDataFrame(rows, "file string, offset long, record string, node int, hash string")


def archive(rng, files=3, records=40):
    rows = []
    for f in range(files):
        offset = 0
        for _ in range(records):
            text = "r" * rng.randint(1, 400)
            rows.append((f"f{f}", offset, text, 1, "h"))
            offset += len(text)
    return rows


def test_audit_finds_exactly_the_records_that_differ(spark):
    rng = random.Random(1)
    left = archive(rng)
    right = list(left)
    right[7] = (*right[7][:2], right[7][2][:-1] + "X", 1, "h")
    del right[50]
    right.append(("f9", 3, "alone", 1, "h"))
    found = fixity.audit(replica(spark, left), replica(spark, right), leaf_bytes=512, fanout=3)
    want = [(left[7][0], left[7][1], "changed"), (left[50][0], left[50][1], "missing"), ("f9", 3, "extra")]
    assert by_row(found, "file", "offset", "status") == sorted(want, key=repr)


def test_equal_and_empty_replicas_have_no_differences(spark):
    rows = archive(random.Random(2), 1, 5) + [(None, None, None, 1, "h"), ("f0", 0, "twice", 1, "h"), ("f0", 0, "twice", 1, "h")]
    same = replica(spark, rows)
    assert fixity.audit(same, same).count() == 0
    none = replica(spark, [])
    assert fixity.audit(none, none).count() == 0
    assert {r["status"] for r in fixity.audit(same, none).collect()} == {"missing"}


def test_number_of_copies_of_a_record_matters(spark):
    once, twice = [("f", 0, "a", 1, "h")], [("f", 0, "a", 1, "h")] * 2
    assert by_row(fixity.audit(replica(spark, once), replica(spark, twice)), "status") == [("changed",)]


def test_records_follow_each_other_without_gaps(spark):
    pages = spark.createDataFrame([(1, "u", "é"), (2, None, None), (None, "u", "x"), (2, "u", "x"), (700, "u", "y")], "page_id long, url string, html string")
    rows = fixity.records(pages, pages_per_file=500).collect()
    for name in {r["file"] for r in rows}:
        own = sorted((r["offset"], len(r["record"].encode())) for r in rows if r["file"] == name)
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))]


def day(n):
    return datetime.date(2024, 1, 1) + datetime.timedelta(days=n)


def brute(url, fetched, entries):
    host = lists_host(url)
    if host is None or fetched is None:
        return (host, 0, None, None, False)
    labels = host.split(".")
    names = [".".join(labels[k:]) for k in range(max(1, len(labels) - 1))]
    active = []
    for name in names:
        own = {}
        for domain, on, action in entries:
            if domain and domain.lower() == name and on is not None and action in lists.ACTIONS and on <= fetched:
                own[on] = max(own.get(on, -1), lists.ACTIONS.index(action))
        if own and (last := own[max(own)]):
            active.append((name, lists.ACTIONS[last]))
    best = max(active, key=lambda x: len(x[0]), default=(None, None))
    return (host, len(active), *best, best[1] == "block")


def lists_host(url):
    if not url or "://" not in url:
        return None
    return url.split("://", 1)[1].split("/")[0].split("@")[-1].split(":")[0].lower() or None


def test_captures_see_the_entries_of_their_day(spark):
    rng = random.Random(5)
    hosts = ["a.example.com", "b.a.example.com", "example.com", "Other.org", "org", "x.y.z.net"]
    entries = [(rng.choice([*hosts, "z.net", None]), rng.choice([day(rng.randint(0, 90)), None, day(5)]), rng.choice([*lists.ACTIONS, "odd", None])) for _ in range(60)]
    captures = [(k, f"https://u@{rng.choice(hosts)}:80/p", day(rng.randint(0, 120))) for k in range(80)] + [(90, None, day(1)), (91, "no address", day(1)), (92, "http://example.com", None), (1, "https://a.example.com/", day(3)), (1, "https://a.example.com/", day(3))]
    table = spark.createDataFrame([(*c, "m", "d") for c in captures], "page_id long, url string, fetched_on date, month string, domain string")
    listed = spark.createDataFrame(entries, "domain string, listed_on date, action string")
    want = sorted(((k, *brute(u, f, entries)) for k, u, f in captures), key=repr)
    assert by_row(lists.judged(table, listed), "page_id", "host", "n_active", "decided_by", "action", "blocked") == want
    assert lists.judged(table, listed.limit(0)).filter("blocked").count() == 0
    assert lists.judged(table.limit(0), listed).count() == 0
