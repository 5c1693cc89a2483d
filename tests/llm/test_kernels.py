"""Operators against brute force and libraries, without Spark."""

import hashlib
import random
import re
import zlib

import numpy as np
import xxhash
from tokenizers import Tokenizer

from linkforge.llm import ann, bpe, html_extract, iblt, language, simhash, warc


def test_fingerprint_by_definition():
    text = "The CAT\tsat é on the cat sat\n\x0b é on"
    words = ["the", "cat", "sat", "é", "on", "the", "cat", "sat", "é", "on"]
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(8)]
    want = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > 8)
    assert simhash.fingerprint(simhash.shingle_hashes(text, 3)) % (1 << 64) == want
    assert simhash.fingerprint(simhash.shingle_hashes(None, 3)) == 0
    assert simhash.fingerprint(simhash.shingle_hashes("One two", 3)) % (1 << 64) == xxhash.xxh64_intdigest(b"one two", 42)


def test_bpe_equals_the_library():
    lib, own = Tokenizer.from_file(bpe.default_path()), bpe.vocabulary(bpe.default_path())
    draw = random.Random(3)
    texts = ["", "<|endoftext|>a <|endoftext|>", "x" * 400, "aé漢字 " * 50, " \n\t x  y  ", "we'll don't 12 345!!"]
    texts += ["".join(draw.choices("abcdeé ß漢\n'1!", k=draw.randint(1, 200))) for _ in range(100)]
    for t in texts:
        ids = lib.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == ids
        assert own.decode(ids) == lib.decode(ids, skip_special_tokens=False) == t
    for n in (127, 128, 129, 300):
        w = "".join(draw.choices("theinga", k=n)).encode()
        assert own._scan(w) == own._heap(w)


def test_sketches_recover_differences():
    draw = np.random.default_rng(5)
    pairs = []
    for n in (0, 1, 5, 40, 3000):
        common, a, b = (draw.integers(1, 1 << 63, size=k, dtype=np.uint64) for k in (n, n // 2, n))
        pairs.append((np.concatenate([common, a]), np.concatenate([common, b])))
    assert iblt.differences(pairs) == [(n // 2, n) for n in (0, 1, 5, 40, 3000)]
    few = [np.sort(draw.integers(1, 1 << 63, size=k, dtype=np.uint64)) for k in (9, 2, 3)]
    a, b = np.concatenate([few[0], few[1]]), np.concatenate([few[0], few[2]])
    x, y = (iblt.Sketches.of([k], np.array([iblt.CELLS])).text(0, len(k)) for k in (a, b))
    only_a, only_b, near = iblt.compare_fingerprints(x, y)
    assert sorted(only_a) == few[1].tolist() and sorted(only_b) == few[2].tolist() and near == 18 / 23
    assert iblt.compare_fingerprints(x, iblt.Sketches.of([draw.integers(1, 1 << 63, size=500, dtype=np.uint64)], np.array([iblt.CELLS])).text(0, 500)) is None
    assert iblt.edited("abcdef", "XY") == "abcXY" and iblt.edited("abc", "") == "ab"


def test_html_of_many_kinds():
    page = """<html><body class="has-sidebar"><header><h1>Site</h1></header><div id="cookie-notice"><p>We use cookies, fine, ok</p></div>
    <main><article><header><h1>T &amp; x</h1><p>by A</p></header><p>One,  two<br>three <b>bold</p><p>Four&nbsp;five <a href=x>link</a>.<ul><li>a<li>b</ul>
    <aside>side</aside><script>var a="<p>no</p>"</script><form><input><p>name</p></form><div class="share-bar">share</div></article>
    <section id="comments"><p>Nice, really, nice, post</p></section></main><footer>f</footer></body></html>"""
    assert html_extract.extract(page) == "T & x\nOne, two three bold\nFour five link.\na\nb"
    assert html_extract.extract(None) == html_extract.extract("") == html_extract.extract("<div></div>") == ""
    assert html_extract.extract("just text &lt;3") == "just text <3"
    assert html_extract.extract("<div>" * 3000 + "deep text") == "deep text"
    plain = "<div class=menu><a>x</a></div><div><h2>Head</h2><p>Some long enough text, with commas, to win the score of this page.</p><p>More of it.</p></div>"
    assert html_extract.extract(plain).split("\n")[-2:] == ["Some long enough text, with commas, to win the score of this page.", "More of it."]


def _page(body):
    return html_extract.extract(f"<html><body>{body}</body></html>").split("\n")


def test_class_words_lower_a_score_but_remove_no_holder_of_the_text():
    assert _page('<div class="content-with-sidebar"><h1>T</h1><p>One, two, three.</p><p>Four.</p></div>') == ["T", "One, two, three.", "Four."]
    assert _page('<main><article class="post-with-comments"><h1>T</h1><p>One, two.</p></article></main>') == ["T", "One, two."]
    assert _page('<main><article class="commented comments"><h1>T</h1><p>One, two.</p></article></main>') == ["T", "One, two."]
    assert _page('<div id="comment-policy"><h1>Policy</h1><p>Be nice, be kind.</p></div>') == ["Policy", "Be nice, be kind."]
    assert _page('<article><div class="entry-header"><h1>T</h1><p>by A</p></div><p>One, two.</p><p class="discussion">Three.</p></article>') == ["T", "One, two.", "Three."]
    assert _page('<form id="page"><div><h1>T</h1><p>One, two.</p></div><div class="sidebar"><p>x</p></div></form>') == ["T", "One, two."]
    assert _page("<div hidden><p>only text</p></div>") == ["only text"]


def test_siblings_and_lists_are_kept_and_comments_are_not():
    text = "Many words, with commas, and more, and more, of them, to score, well, enough."
    two = f"<article><h2>A</h2><p>{text}</p></article><article><h2>B</h2><p>{text}</p></article><article class='comment'><p>{text}</p></article>"
    assert _page(two) == ["A", text, "B", text]
    links = "<ul><li><a href=a>Smith 2001</a><li><a href=b>Jones 2002</a><li><a href=c>Doe 2003</a></ul>"
    assert _page(f"<article><h1>T</h1><p>{text}</p><h2>References</h2>{links}</article>") == ["T", text, "References", "Smith 2001", "Jones 2002", "Doe 2003"]
    assert _page(f"<article>{links}<h1>T</h1><p>{text}</p></article>") == ["T", text]
    talk = "<p>first! nice, nice, post</p>"
    for comments in (f"<h3>Comments (3)</h3>{talk}", f"<section><h3>Reader comments</h3>{talk}</section>", f'<div class="reader-notes">{talk}</div>', f'<div id="comments">{talk}</div>'):
        assert _page(f"<article><h1>T</h1><p>{text}</p>{comments}</article>") == ["T", text]
        assert _page(f"<main><article><h1>T</h1><p>{text}</p></article>{comments}</main>") == ["T", text]


def test_scores_by_brute_force():
    draw = random.Random(4)
    for _ in range(60):
        todo, page = draw.randint(5, 60), []
        open_ = []
        for _ in range(todo):
            tag = draw.choice(["div", "section", "div class=comments", "p", "p", "article", "blockquote", "/"])
            if tag == "/" and open_:
                page.append(f"</{open_.pop()}>")
            elif tag == "p":
                page.append("<p>" + "word, word " * draw.randint(0, 40) + "</p>")
            elif tag != "/":
                page.append(f"<{tag}>")
                open_.append(tag.split()[0])
        root = html_extract.parse("".join(page))
        order = html_extract._prepare(root)
        want = {}
        for node in order:  # from the container's side: every paragraph below it, by its distance
            chain_of = lambda x: [] if x is None else [x, *chain_of(x.parent)]
            total = html_extract.BASE_SCORE.get(node.tag, 0.0)
            for para in order:
                words = html_extract._own_text(para)
                if para.tag not in ("p", "blockquote") or not words or node is para or node not in chain_of(para):
                    continue
                up = chain_of(para)
                level = up.index(node) - 1
                doubts = sum(bool(x.doubt) for x in up[: level + 2])
                if level < 6:
                    total += (1 + len(re.findall(",", words)) + min(len(words) // 100, 3)) * html_extract.DOUBTED**doubts / max(1, 2 * level)
            want[id(node)] = total
        html_extract._score(order)
        assert all(abs(n.score - want[id(n)]) < 1e-9 for n in order)


def _response(page_id, payload):
    return warc.record(page_id, f"http://x/{page_id}", payload, hashlib.sha256(payload).hexdigest(), len(payload), None)


def test_salvage_checks_both_digests():
    wrong = warc.record(1, "u", b"page", hashlib.sha256(b"another").hexdigest(), 4, None)
    found = list(warc.salvage(_response(0, b"a") + wrong + _response(2, b"b")))
    assert [x.reason if isinstance(x, warc.Gap) else x.headers["warc-record-id"] for x in found] == ["<urn:page:0>", "payload digest differs", "<urn:page:2>"]
    block = _response(1, b"page").replace(b"page", b"pagf")
    assert [x.reason for x in warc.salvage(block)] == ["block digest differs"]


def test_salvage_recovers_later_records():
    records = [_response(i, f"payload {i}".encode() * 50) for i in range(6)]
    members = [warc._member(r) for r in records]
    whole = warc.EMPTY_MEMBER.join(members)
    assert len(list(warc.salvage(whole))) == 6
    broken = bytearray(whole)
    at = whole.index(members[2]) + 40
    broken[at : at + 8] = b"\0" * 8
    found = list(warc.salvage(bytes(broken)))
    gaps = [x for x in found if isinstance(x, warc.Gap)]
    ids = [x.headers["warc-record-id"] for x in found if isinstance(x, warc.Record)]
    assert ids == [f"<urn:page:{i}>" for i in (0, 1, 3, 4, 5)]
    assert len(gaps) == 1 and gaps[0].offset == whole.index(members[2])
    plain = b"".join(records)
    hurt = plain[: len(records[0]) + 30] + plain[len(records[0]) + 90 :]
    ids = [x.headers["warc-record-id"] for x in warc.salvage(hurt) if isinstance(x, warc.Record)]
    assert ids == [f"<urn:page:{i}>" for i in (0, 2, 3, 4, 5)]
    assert [type(x) for x in warc.salvage(b"junk")] == [warc.Gap] and list(warc.salvage(b"")) == []


def test_salvage_inside_members():
    records = [_response(i, random.Random(i).randbytes(3000)) for i in range(5)]
    bad = records[1].replace(b"Content-Length: ", b"Content-Length: 9", 2)
    name = lambda x: x.reason.split(";")[0] if isinstance(x, warc.Gap) else x.headers["warc-record-id"][10:-1]
    length = "length does not end at the record's end"
    whole = warc._member(records[0] + bad + b"".join(records[2:]))
    found = list(warc.salvage(whole + warc._member(records[0])))
    assert [name(x) for x in found] == ["0", length, "2", "3", "4", "0"] and {(x.offset, x.length) for x in found[:5]} == {(0, len(whole))}
    assert found[1].reason.endswith(f"inflated bytes {len(records[0])} to {len(records[0] + bad)}")
    member = warc._member(b"".join(records))
    cut = member[: len(member) * 7 // 10]
    found = list(warc.salvage(cut))
    assert [name(x) for x in found] == ["0", "1", "2", "gzip member is cut off"] and found[-1].offset + found[-1].length == len(cut)
    after = list(warc.salvage(cut + warc._member(records[4])))
    assert [name(x) for x in after if isinstance(x, warc.Record)] == ["0", "1", "2", "4"]
    stored = zlib.compressobj(0, zlib.DEFLATED, 31)  # its records can be read in the member's own bytes too
    plain = stored.compress(b"".join(records)) + stored.flush()
    assert [name(x) for x in warc.salvage(b"junk" + plain[:-4]) if isinstance(x, warc.Record)] == list("01234")


def test_tree_places_every_vector_and_visits_every_leaf():
    v = np.random.default_rng(1).normal(size=(800, 8))
    v[:300] = v[0]
    tree = ann.fit_tree(v, 20)
    assert set(tree.assign(v)) <= set(range(tree.leaves))
    assert sorted(tree.visit(v[5], tree.leaves)) == list(range(tree.leaves))


def test_language_model_and_its_empty_cases():
    rows = [(i, "the cat and the dog ran on " * 3, "en") for i in range(40)] + [(100 + i, "der hund und die katze liefen zu ", "de") for i in range(40)]
    model = language.train(rows)
    labels, scores = model.score(["the dog and the cat", "die katze und der hund", "", None, "12 !", "Ω"])
    assert labels[:5] == ["en", "de", "und", "und", "und"] and labels[5] in ("en", "de")
    assert all(0 <= s <= 1 for s in scores)
    assert language.train([]).score(["text"]) == (["und"], [0.0])
