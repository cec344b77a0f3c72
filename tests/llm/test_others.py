import math
import random
import re

import pytest

from mnemospark.llm import chat_format as C
from mnemospark.llm import license_scan as S
from mnemospark.llm import merkle as M
from mnemospark.llm import url_filter as U

CHAT = "conv_id long, turn long, role string, text string, body string, depth string"


def chat(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], CHAT)


def test_quotes_link_to_their_messages(spark):
    rows = [
        (1, 0, "user", "How do I sort a list?\nIn place, please."),
        (1, 1, "assistant", "Use list.sort() for that."),
        (1, 2, "user", "> Use  LIST.sort() for that!\nAnd reversed?"),
        (1, 3, "assistant", "> > Use list.sort() for that.\n> And reversed?\n\nPass reverse=True."),
        (1, 4, "user", "> In place, please.\nWhy that?"),
        (2, 0, "user", "> Pass reverse=True.\nSeen elsewhere."),
        (2, 1, "assistant", "> never said by anyone\nHm."),
        (3, 0, None, None), (3, 1, "user", ""), (3, 2, "user", ">>> \n>"), (None, 1, "user", "Use list.sort() for that."), (4, None, "user", "x"),
        (1, 2, "user", "> Use  LIST.sort() for that!\nAnd reversed?"),
    ]
    got = {(r.conv_id, r.turn): r for r in C.link_quotes(chat(spark, rows)).collect()}
    link = lambda *k: (got[k].parent_conv, got[k].parent_turn, got[k].root_turn, got[k].depth)
    assert link(1, 0) == (None, None, 0, 0) and link(1, 2) == (1, 1, 1, 1)
    assert link(1, 3) == (1, 2, 1, 2)  # level 1 quotes turn 2, level 2 what that quoted
    assert link(1, 4) == (1, 0, 0, 1) and link(2, 0) == (1, 3, 1, 3) and link(2, 1) == (None, None, 1, 0)
    assert got[1, 3].body == "Pass reverse=True." and got[1, 3].n_quoted == 2 and got[1, 3].max_level == 2
    assert C.link_quotes(chat(spark, rows)).count() == len(rows)
    convs = {}
    for r in C.conversations(C.link_quotes(chat(spark, rows[:6]))).collect():
        convs.setdefault(r.conversation, []).append(r.content)
    assert convs == {1: ["How do I sort a list?\nIn place, please.", "Why that?", "Use list.sort() for that.", "And reversed?", "Pass reverse=True.", "Seen elsewhere."]}


def test_places_across_ranges(spark):
    rows = [(1, i, "user", f"turn {i}") for i in range(300)] + [(2, i, "user", f"> turn {i * 7}\nother {i}") for i in range(40)]
    got = {(r.conv_id, r.turn): r.position for r in C.link_quotes(chat(spark, rows)).collect()}
    want = sorted([(i, 1, i) for i in range(300)] + [(i * 7, 2, i) for i in range(40)])
    assert got == {(c, t): k for k, (_, c, t) in enumerate(want)}


def test_very_long_message(spark):
    long = "\n".join(f"line {i} of many" for i in range(20_000))
    got = {r.turn: (r.parent_turn, r.n_quoted, len(r.body)) for r in C.link_quotes(chat(spark, [(1, 0, "user", long), (1, 1, "user", "> line 19999 of many\nyes"), (1, 2, "user", "\n".join("> " + x for x in long.split("\n")))])).collect()}
    assert got == {0: (None, 0, len(long)), 1: (0, 1, 3), 2: (0, 20_000, 0)}


def test_trimmed_quote_links(spark):
    rows = [
        (1, 0, "user", "first point\nsecond point\nthird point\nfourth point\nfifth point"),
        (1, 1, "assistant", "noted\nthird point"),
        (1, 2, "user", "> second point\n> third point\nI doubt these."),
        (1, 3, "assistant", "> > second point\n> > third point\n> I doubt these.\nWhy?"),
        (1, 4, "user", "> noted\n> third point\nWhole, so it wins."),
    ]
    got = {r.turn: (r.parent_turn, r.root_turn, r.depth) for r in C.link_quotes(chat(spark, rows)).collect()}
    assert got == {0: (None, 0, 0), 1: (None, 1, 0), 2: (0, 0, 1), 3: (2, 0, 2), 4: (1, 1, 1)}


def test_chat_empty_and_common_passage(spark):
    assert C.link_quotes(chat(spark, [])).collect() == []
    rows = [(i, 0, "user", "thanks") for i in range(200)] + [(i, 1, "user", "> thanks\nok") for i in range(200)]
    got = C.link_quotes(chat(spark, rows)).where("turn = 1").collect()
    assert all((r.parent_conv, r.parent_turn) == (r.conv_id, 0) for r in got)


def test_long_reply_chain(spark):
    rows = [(1, 0, "user", "start here")] + [(1, i, "user", f"> line {i - 1} said\nline {i} said" if i > 1 else "> start here\nline 1 said") for i in range(1, 40)]
    got = {r.turn: r for r in C.link_quotes(chat(spark, rows)).collect()}
    assert all(got[i].depth == i and got[i].root_turn == 0 for i in range(40))


def best_licence(text, whole, texts, found=S.TEMPLATES):
    """Every line, block and whole file against every template, in plain Python."""
    toks = lambda t: re.findall(r"[^\W_]+", t.lower())
    n = len(texts)
    df = lambda w: sum(w in toks(x or "") for x in texts)
    idf = {w: 1 + math.log((n + 1) / (df(w) + 1)) for _, t in found for w in toks(t)}
    weigh = lambda t: {w: toks(t).count(w) * idf.get(w, 1 + math.log(n + 1)) for w in set(toks(t))}
    size = lambda v: math.sqrt(sum(x * x for x in v.values()))
    known = [(k, weigh(t)) for k, t in found]
    best = (0.0, None)
    for c in {*re.split("\r?\n", text or ""), *re.split("\r?\n[ \t]*\r?\n", text or ""), *([text] if whole and text else [])}:
        v = weigh(c)
        for name, t in known if v else ():
            score = round(sum(x * t.get(w, 0) for w, x in v.items()) / (size(v) * size(t)), 6)
            if score >= S.LEAST and (-score, name) < (-best[0], best[1] or ""):
                best = score, name
    return best[1], best[0] or None


FILES = "id long, path string, text string, score string, licence string, line string"


def test_licences_and_inheritance(spark):
    rows = [
        (1, "a/LICENSE", "Released under the MIT License."), (2, "a/x.py", "no notice"), (3, "a/b/c/y.py", ""), (4, "a/b/LICENSE.txt", "This work is licensed under the GNU General Public License, version 3."),
        (5, "a/b/c/z.py", "# Licensed under the Apache License, Version 2.0\ncode\n" + "filler\n" * 500), (6, "top.py", "x"), (7, None, "Licensed under CC BY-NC 4.0."), (8, "a/b2/q.py", None), (9, "a/b/LICENSE.txt", "license? no idea"),
        (10, "copyright.txt", "copyright by me and nobody else at all, really"), (2, "a/x.py", "no notice"),
    ]
    got = S.scan(spark.createDataFrame([(*r, "s", "l", "n") for r in rows], FILES)).collect()
    assert len(got) == len(rows)
    of = {r.id: r for r in got}
    assert [of[i].licence for i in (1, 2, 3, 4, 5, 6, 7, 8)] == ["MIT", "MIT", "GPL-3.0", "GPL-3.0", "Apache-2.0", None, "CC-BY-NC-4.0", "MIT"]
    assert of[3].inherited_from == "a/b/LICENSE.txt" and of[5].inherited_from is None and of[8].inherited_from == "a/LICENSE"
    texts = [r[2] for r in rows]
    for i, path, text in rows[:8] + rows[9:10]:
        want = best_licence(text, bool(path) and "LICENSE" in path, texts)
        assert (of[i].own_licence, of[i].score) == (want[0], pytest.approx(want[1], abs=2e-6) if want[1] else None)
    assert S.scan(spark.createDataFrame([], FILES)).collect() == []


def commented(text, mark="# "):
    return "\n".join((mark + x).rstrip() for x in text.split("\n")) + "\n\nimport this\n"


def test_real_licences(spark):
    from mnemospark.llm import licences as L

    mit = "MIT License\n\nCopyright (c) 2024 Jane Doe\n\n" + L._MIT
    bsd2, bsd3 = f"Copyright 2020 X\n\n{L._BSD_START}\n\n{L._BSD_END}", f"Copyright 2020 X\n\n{L._BSD_START}\n\n{L._BSD_NAMES}\n\n{L._BSD_END}"
    gpl = "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Everyone is permitted to copy and distribute verbatim copies of this document.\n\n" + "The terms go on and on here, clause by clause. " * 400 + "\n\n    " + L._GPL_GRANT
    apache = "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n" + "Definitions and grants of rights follow. " * 300
    gpl_header = "Copyright (C) 2021 Someone\n\n" + L._GPL_GRANT.replace("Public License as", "Public License\nas") + "\n\n" + L._GPL_END
    cases = [("m/LICENSE", mit, "MIT"), ("m/deep/er/x.c", "int x;", "MIT"), ("b2/LICENSE", bsd2, "BSD-2-Clause"), ("b3/COPYING", bsd3, "BSD-3-Clause"), ("g/COPYING", gpl, "GPL-3.0"), ("g/a.c", None, "GPL-3.0"), ("a/LICENSE.txt", apache, "Apache-2.0"),
        ("h1.py", commented(gpl_header), "GPL-3.0"), ("h2.py", commented(L._APACHE), "Apache-2.0"), ("h3.py", commented(L._MIT), "MIT"), ("h4.py", commented(L._MPL), "MPL-2.0"), ("h5.c", "// SPDX-License-Identifier: MIT\ncode", "MIT"), ("h6.c", "/* SPDX-License-Identifier: Apache-2.0 */", "Apache-2.0"),
        ("h7.py", commented(L._variant(L._GPL_GRANT + "\n\n" + L._GPL_END, "Lesser ", "2.1")), "LGPL-2.1"), ("h8.py", "# do what you like, no licence at all\nx = 1", None), ("h9.py", "permission to use the software in source form", None)]
    plain = [(None, f"p/{i}.txt", "words of no importance in a file that the software made " * 5) for i in range(40)]
    rows = [(None, p, t) for p, t, _ in cases] + plain
    got = {r.path: r.licence for r in S.scan(spark.createDataFrame([(*r, "s", "l", "n") for r in rows], FILES)).collect()}
    assert {p: got[p] for p, _, _ in cases} == {p: want for p, _, want in cases} and not any(got[p] for _, p, _ in plain)


def test_files_are_told_apart_without_ids(spark):
    rows = [(None, "a/x", "Released under the MIT License."), (None, "b/x", "nothing"), (7, "c/x", "nothing"), (7, "d/x", "Licensed under CC BY 4.0.")]
    got = {r.path: (r.own_licence, r.licence) for r in S.scan(spark.createDataFrame([(*r, "s", "l", "n") for r in rows], FILES)).collect()}
    assert got == {"a/x": ("MIT", "MIT"), "b/x": (None, None), "c/x": (None, None), "d/x": ("CC-BY-4.0", "CC-BY-4.0")}


def test_inheritance_of_brute_force(spark):
    r = random.Random(8)
    notices = {"MIT": "Released under the MIT License.", "CC-BY-4.0": "Licensed under CC BY 4.0.", None: "hello"}
    rows = []
    for i in range(120):
        folder = "/".join(r.choice("abc") for _ in range(r.randrange(0, 5)))
        rows.append((i, (folder + "/" if folder else "") + r.choice(["LICENSE", "f.py", "g.py"]), notices[r.choice([*notices, None, None])]))
    given = {}
    name = {v: k for k, v in notices.items()}
    for _, p, t in rows:
        folder, _, file = p.rpartition("/")
        if file == "LICENSE" and name[t]:
            given.setdefault(tuple(folder.split("/")) if folder else (), set()).add(name[t])
    got = {x.id: x.licence for x in S.scan(spark.createDataFrame([(*x, "s", "l", "n") for x in rows], FILES)).collect()}
    for i, p, t in rows:
        parts = tuple(p.split("/")[:-1])
        near = next((given[parts[:k]] for k in range(len(parts), -1, -1) if parts[:k] in given), {None})
        assert got[i] in ({name[t]} if name[t] else near)


def test_rules(spark):
    rows = [(1, "https://a.b.NET/x"), (2, "http://net/"), (3, "http://w.example.net/en/1?x#y"), (4, "http://example.net/english"), (5, "ftp://x.example.com/de/"), (6, "http://example.com/de"),
            (7, "http://o.org/fr/2"), (8, "http://o.org/fr?"), (9, "no scheme"), (10, None), (11, "http://notexample.com/de/3"), (12, "http://b.net#frag"), (13, "x://h/a://b/c"), (14, "http://u.net"), (1, "https://a.b.NET/x")]
    df = spark.createDataFrame([(*r, None, "t") for r in rows], "page_id long, url string, html string, trust string")
    got = U.filter_urls(df).collect()
    assert len(got) == len(rows)
    of = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got}
    assert of[1] == ("a.b.net", "/x", "net/", "block") and of[2][2:] == ("net/", "block") and of[3] == ("w.example.net", "/en/1", "example.net/en/", "allow")
    assert of[4][2] == "net/" and of[5][2:] == ("example.com/de/", "block") and of[6][2] is None and of[7][2] == "org/fr/" and of[8][1:3] == ("/fr", None)
    assert of[9][:2] == ("", "") == of[10][:2] and of[11][2] is None and of[12] == ("b.net", "", None, of[12][3]) and of[13][:2] == ("h", "/a://b/c")
    assert U.filter_urls(df.limit(0)).collect() == []


def pagerank(seeds, links, rounds):
    score, nodes = dict(seeds), {*seeds, *(x for s, d, _ in links for x in (s, d))}
    for _ in range(rounds):
        out = {h: sum(n for s, _, n in links if s == h) for h in nodes}
        rest = sum(score.get(h, 0) for h in nodes if not out[h]) / sum(seeds.values())
        score = {h: seeds.get(h, 0) * (0.15 + 0.85 * rest) + 0.85 * sum(score.get(s, 0) * n / out[s] for s, d, n in links if d == h) for h in nodes}
    return score


def _ranked(spark, seeds, links):
    seed = spark.createDataFrame([("k", *x) for x in seeds.items()], "kind string, host string, seed double")
    got = U.propagate(seed, spark.createDataFrame([("k", *x) for x in links], "kind string, src string, dst string, n long")).collect()
    scale = sum(seeds.values()) / sum(x.score for x in got)
    return {x.host: x.score * scale for x in got}


def test_propagation(spark):
    r = random.Random(3)
    links = [(f"h{a}", f"h{b}", r.randrange(1, 4)) for a in range(9) for b in r.sample(range(12), 3) if a != b]
    seeds = {"h0": 1.0, "h5": 0.5, "h11": 0.25}
    got, want = _ranked(spark, seeds, links), pagerank(seeds, links, 300)
    assert got == pytest.approx({h: v for h, v in want.items() if v}, abs=1e-6) and sum(want.values()) == pytest.approx(1.75)


def test_propagation_settles_on_a_ring(spark):
    links = [(f"h{i}", f"h{(i + 1) % 50}", 1) for i in range(50)]
    assert _ranked(spark, {"h0": 1.0}, links) == pytest.approx({f"h{i}": 0.15 * 0.85**i / (1 - 0.85**50) for i in range(50)}, abs=1e-6)


def test_linkers_to_blocked_hosts_are_blocked(spark):
    link = "<a href='http://bad.net/x'>" * 3
    rows = [(1, "http://bad.net/x", ""), (2, "http://friend.com/a", link), (3, "http://other.com/a", "<a href=/local>"), (4, "http://far.com/", '<a href="//friend.com/q">')]
    got = {r.host: r.verdict for r in U.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {"bad.net": "block", "friend.com": "block", "other.com": "allow", "far.com": "block"}


def test_hosts_of_a_connected_graph_are_blocked(spark):
    link = lambda i: f"<a href='http://h{(i + 1) % 20}.com/'>"
    rows = [(i, f"http://h{i}.com/", link(i)) for i in range(20)] + [(100 + i, f"http://h7.com/bad/{i}", link(7)) for i in range(9)]
    got = {r.page_id: r.verdict for r in U.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string"), rules=(("h7.com/bad/", "block"),)).collect()}
    assert got[7] == got[6] == "block"  # the page that no rule fits, and the host that links there only
    assert got[8] == got[17] == "allow"  # linked by it, and far from it


RECORDS = "page_id long, url string, html string, idx string, digest string"


def records(spark, rows):
    return spark.createDataFrame([(*r, "i", "d") for r in rows], RECORDS)


def test_audit_finds_each_fault(spark):
    a = [(i, f"u{i}", "h" * (i % 7)) for i in range(0, 900, 2)] + [(None, "n", None), (4, "again", "x"), (6, None, "")]
    b = [r for r in a if r[0] != 10 and r[0] != 880]
    b = [(r[0], r[1], "changed" if r[0] in (4, 300, None) and r[1] != "again" else r[2]) for r in b] + [(301, "new", "x"), (100_000, "far", "y")]
    b = [(r[0], "" if r[0] == 6 and r[1] is None else r[1], r[2]) for r in b]
    got = {r.idx: (r.fault, r.offset, r.length) for r in M.audit(records(spark, a), records(spark, b), "page_id", ("url", "html")).collect()}
    size = lambda k: sum(len(u or "") + len(h or "") for i, u, h in a if i == k)
    rank = lambda k: (k is not None, k or 0)
    place = lambda k: sum(size(i) for i in {x[0] for x in a} if rank(i) < rank(k))
    want = {None: "changed", 4: "changed", 300: "changed", 6: "changed", 10: "missing", 880: "missing", 301: "extra", 100_000: "extra"}
    assert got == {k: (f, place(k), size(k)) for k, f in want.items()}


def test_audit_tells_records_without_id_from_all_ids(spark):
    a = [(None, "n", "x"), (-1, "m", "y"), (-40, "low", "z" * 9), (5, "p", "long " * 40_000)]
    b = [(None, "m", "y"), (-1, "n", "x"), (-40, "low", "z" * 9), (5, "p", "long " * 40_000)]
    got = lambda x, y: {(r.idx, r.fault, r.offset, r.length) for r in M.audit(records(spark, x), records(spark, y), "page_id", ("url", "html")).collect()}
    assert got(a, b) == {(None, "changed", 0, 2), (-1, "changed", 2 + 12, 2)}
    assert got(a, [r for r in a if r[0] != -1]) == {(-1, "missing", 14, 2)}
    assert got(a, a[1:]) == {(None, "missing", 0, 2)}


def test_audit_of_equal_or_empty_replicas(spark):
    a = records(spark, [(i, "u", "h") for i in range(50)] + [(3, "u", "h")])
    assert M.audit(a, a.repartition(3), "page_id", ("url", "html")).collect() == []
    assert M.audit(a.limit(0), a.limit(0), "page_id", ("url", "html")).collect() == []
    assert M.audit(a, a.limit(0), "page_id", ("url", "html")).count() == 50
