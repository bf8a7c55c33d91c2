from __future__ import annotations

import hashlib
import random
import time
from collections import defaultdict

import pytest
from lodestone.llm import html_text as H
from lodestone.llm import mixing as M


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        ("plain &amp; simple &#233;", "plain & simple é"),
        ("<title>no</title><p>one<p>two", "one\n\ntwo"),
        ("a<br>b<br><br>c", "a\nb\n\nc"),
        ("<div>a</div><div>b</div>", "a\nb"),
        ("x<script>if (a<b) {}</script><style>p{}</style>y", "xy"),
        ("<ul><li>one<li>two<ol start=3><li>a<li>b</ol></ul>", "- one\n- two\n  3. a\n  4. b"),
        ("<table><tr><th>Name<th>N<tr><td>long name<td>1</table>", "Name       N\nlong name  1"),
        ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "a  b\n   c"),
        ("<table><tr><td colspan=2>wide cell<tr><td>x<td>y</table>", "wide cell\nx  y"),
        ("<pre>\n a\n  b\n</pre>c", " a\n  b\n\nc"),
        ("a<div hidden>b</div><p style='display : none'>c</p><span style='visibility:hidden'>d<b style='visibility:visible'>e</b></span>", "ae"),
        ("<details><summary>s</summary>t</details><details open><summary>u</summary>v</details>", "s\nu\nv"),
        ("a<!-- b -->c<!-- never ends", "ac"),
        ("5 < 6 <a title='x>y'>link</a>", "5 < 6 link"),
        ("a<p", "a"),
        ("<b>bold <i>both</b> rest</i>", "bold both rest"),
        ("a&nbsp;b \x00c", "a b c"),
        ("<dl><dt>t<dd>d</dl>", "t\n  d"),
        ("<select><option>a<option>b</select>", "a\nb"),
    ],
)
def test_rendering(page, text):
    assert H.extract(page) == text


@pytest.mark.parametrize("piece", ["<div>", "<table><tr><td>", "<p", "</p>", "<!--", "<b>", "<li>", '<a b="', "<ul><li>", "&amp", "<script>", "<"])
def test_long_and_deep_pages_take_linear_time(piece):
    began = time.process_time()
    H.extract(piece * 20_000 + "x")
    assert time.process_time() - began < 5


def test_pages_table(spark):
    df = spark.createDataFrame([(1, None, "u"), (2, "<p>a", "u"), (2, "<p>a", "u"), (None, "", "u")], "page_id long, html string, text string")
    assert sorted((r.page_id or 0, r.text) for r in H.extract_text(df).collect() if r.text is not None) == [(0, ""), (2, "a"), (2, "a")]
    assert H.extract_text(df).where("text is null").count() == 1
    assert H.extract_text(df.limit(0)).count() == 0


def brute(rows: list[tuple], mix: M.Mix) -> list[tuple]:
    """(doc_id, epoch) by walking the tree."""
    words = {id(r): len((r[1] or "").split()) for r in rows}
    leaves = defaultdict(list)
    for r in rows:
        number = "".join(c for c in (r[3] or "")[3:] if c.isdigit())
        leaves[(f"domain{int(number) % mix.domains}" if number else "none", r[2] or "none", r[3] or "none")].append(r)
    tokens = {k: sum(words[id(r)] for r in v) for k, v in leaves.items()}

    def share(budget: int, nodes: dict[str, tuple[int, int]]) -> dict[str, int]:
        out, open_ = {}, dict(nodes)
        while True:
            rest, weight = budget - sum(out.values()), sum(w for _, w in open_.values())
            full = [n for n, (cap, w) in open_.items() if w and cap * weight <= w * rest]
            if not full:
                return out | {n: (w * rest) // weight if weight else 0 for n, (_, w) in open_.items()}
            first = min(full, key=lambda n: (open_[n][0] / open_[n][1] if open_[n][1] else float("inf"), n))
            out[first] = open_.pop(first)[0]

    weights = (mix.domain_weights, mix.lang_weights, mix.source_weights)

    def down(prefix: tuple, budget: int) -> dict[tuple, int]:
        if len(prefix) == 3:
            return {prefix: budget}
        caps = defaultdict(int)
        for k, t in tokens.items():
            if k[: len(prefix)] == prefix:
                caps[k[len(prefix)]] += t * mix.max_epochs
        got = share(budget, {n: (c, weights[len(prefix)].get(n, mix.default_weight)) for n, c in caps.items()})
        return {k: v for n, b in got.items() for k, v in down((*prefix, n), b).items()}

    out = []
    for leaf, budget in down((), sum(tokens.values()) * mix.percent // 100).items():
        if not tokens[leaf]:
            continue
        full, left = divmod(budget, tokens[leaf])
        for r in leaves[leaf]:
            out += [(r[0], e) for e in range(full)]
        order = sorted(leaves[leaf], key=lambda r: (hashlib.md5(f"{mix.seed}:{full}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[0] is not None, r[0] or 0, words[id(r)]))
        total = 0
        for r in order:
            total += words[id(r)]
            if total > left or not left:
                break
            out.append((r[0], full))
    return sorted(out, key=str)


@pytest.mark.parametrize("mix", [M.Mix(), M.Mix(percent=95, max_epochs=1), M.Mix(percent=250, max_epochs=3), M.Mix(percent=0), M.Mix(domain_weights={"domain0": 0}, default_weight=7)])
def test_mixing_against_the_tree(spark, mix):
    r = random.Random(8)
    rows = [(i if i != 7 else None, " ".join("w" for _ in range(r.choice([0, 1, 5, 50, 200]))) or None, r.choice(["en", "en", "fr", None]), r.choice(["src0", "src0", "src0", "src1", "src5", "src6", "odd", None]), "x", "y") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, epoch string, _x string").repartition(4)
    got = sorted(((x.doc_id, x.epoch) for x in M.mix_sources(df, mix).collect()), key=str)
    assert got == brute(rows, mix)


def test_mixing_an_empty_table(spark):
    df = spark.createDataFrame([(1, "a b", "en", "src1")], "doc_id long, text string, lang string, source string")
    assert M.mix_sources(df.limit(0)).count() == 0
    assert M.mix_sources(df.unionByName(df), M.Mix(percent=100)).count() == 2
