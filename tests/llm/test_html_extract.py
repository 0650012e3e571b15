import html
import random
import re

from marlstone.llm.html_extract import extract_text, main_text

PAGE = """<!DOCTYPE html><html><head><title>No &lt; title</title><style>p{{}}</style></head><body><header><h1>Site</h1></header>
<nav><ul><li><a href=x>Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div><article>{}</article>
<section id="comments"><article class="comment"><p>First!</p></article></section><aside><p>Read this too</p></aside>
<form><p>Sign up</p><input></form><footer>&copy; us</footer><script>var t="</p><p>no";</script></body></html>"""


def test_article_alone():
    text = main_text(PAGE.format("<h1>A &amp; B</h1><p>Some <b>bold</b>\n text<br>more&nbsp;here.<p>Unclosed &eacute;<p>x</p><ul><li>one</li><li>two</li></ul><div class='ad'>Buy</div><!-- no --><script>1</script><p>End.</p>"))
    assert text == "A & B\nSome bold text more here.\nUnclosed é\nx\none\ntwo\nEnd."


def test_without_article():
    body = "<div class=menu><a href=a>One</a> <a href=b>Two</a></div>" + "".join(f"<p>{'words and more ' * 9}{i}.</p>" for i in range(4)) + "<div><a href=z>Next page</a></div>" * 4
    assert main_text(f"<body>{body}</body>") == "\n".join(f"{'words and more ' * 9}{i}." for i in range(4))


LONG = "words and more " * 9


def test_lengths_decide_beside_a_card():
    body = "".join(f"<p>{LONG}{i}.</p>" for i in range(3))
    links = "<p><a href=x>more of this</a></p>" * 4
    want = "\n".join(f"{LONG}{i}." for i in range(3))
    assert main_text(f"<body><div>{body}</div>{links}<article><p>Card</p></article></body>") == want
    assert main_text(f"<body><article><p>Card</p></article>{links}<div>{body}</div></body>") == want


def test_article_that_surges_is_whole():
    body = f"<p>One</p><p>Two</p><p>Three</p><p>Four</p><p>{LONG}</p>" + "<p><a href=x>link</a></p>" * 4 + "<p>End.</p>"
    text = "One\nTwo\nThree\nFour\n" + LONG.strip() + "\nlink" * 4 + "\nEnd."
    assert main_text(f"<article>{body}</article>") == text


def test_every_region_stays():
    part = lambda k, n: "".join(f"<p>{LONG}{k}{i}.</p>" for i in range(n))
    page = f"<body><div>{part('a', 4)}<ul>{'<li><a href=x>link</a></li>' * 3}</ul>{part('b', 2)}</div></body>"
    assert main_text(page) == "\n".join([f"{LONG}a{i}." for i in range(4)] + [f"{LONG}b{i}." for i in range(2)])


def test_edges():
    assert main_text(None) == main_text("") == main_text("<p></p>") == ""
    assert main_text("plain") == "plain"
    assert main_text("<article><p>a < b & c</p>") == "a < b & c"
    assert main_text("<article><p>" + "long " * 200_000) == ("long " * 200_000).strip()
    assert main_text("<head><title>x<article><p>kept</p></article>") == "kept"


def test_table(spark, sf001):
    pages = spark.read.parquet(f"{sf001}/pages.parquet")
    source = {r.page_id: r.html for r in pages.collect()}
    for r in extract_text(pages.withColumn("text", pages["html"])).collect():
        page = source[r.page_id]
        inner = re.search(r"<article>(.*?)(?:</article>|<footer)", page, re.S)[1].replace("<br>", " ")
        blocks = re.split(r"<[^>]*>", re.sub(r"</?b>", "", inner))
        assert r.text == "\n".join(b for b in (" ".join(html.unescape(x).split()) for x in blocks) if b)
    assert extract_text(pages.where("false")).count() == 0


def test_names_and_broken_attributes_in_an_article():
    body = f"<p class='notice-board'>{LONG}</p><p title=\"it\"s\">Kept &amp; clean.</p><p id=social-history>Old.</p><math><mi>x</mi></math><p class='cookie notice'>no</p><p class=related-links>Rest</p>"
    assert main_text(f'<article>{body}</article><p title="x">y</p>').startswith(f"{LONG.strip()}\nKept & clean.\nOld.\nx\nRest")
    assert main_text(f"<article>{body.replace('related-links', 'share')}</article>") == f"{LONG.strip()}\nKept & clean.\nOld.\nx"


def line_blocks(lines, window=3, surge=80):
    """Which of (own length, linked) lines stay, by the plain definition of surge and dive."""
    own = [0 if linked else n for n, linked in lines]
    kept, on = set(), False
    for i in range(len(own)):
        mass = sum(own[i : i + window])
        on = on and mass > 0 or not on and own[i] > 0 and mass >= surge
        if on and any(own[j] for j in range(i, len(own)) if not any(sum(own[k : k + window]) == 0 for k in range(i, j + 1))):
            kept.add(i)
    return kept or {i for i in range(len(own)) if own[i] and not any(own[j] and sum(own[j : j + window]) >= surge for j in range(len(own)))}


def test_line_blocks_by_brute_force():
    rng = random.Random(8)
    for _ in range(400):
        lines = [(rng.choice([4, 9, 30, 60, 120]), rng.random() < rng.choice([0.2, 0.7])) for _ in range(rng.randint(1, 14))]
        texts = [(f"{i:02d}" + "x" * n)[:n] for i, (n, _) in enumerate(lines)]
        page = "".join(f"<p><a href=x>{t}</a></p>" if linked else f"<p>{t}</p>" for t, (_, linked) in zip(texts, lines, strict=True))
        assert main_text(page).split("\n") == ([texts[i] for i in sorted(line_blocks(lines))] or [""])


def test_hidden_elements_end():
    end = f"<p>{LONG}END</p>"
    for hidden in ("<svg class='i'/>", "<svg class=i/>", "<svg><path/></svg>", "<svg><svg/><title>t</title><g>no</g></svg>", "<video src=x/>", "<canvas><p>no</p></canvas>", "<object><object>no</object>no</object>"):
        for behind in ("", "<svg>no</svg>", "</svg>"):
            assert main_text(f"<article><h1>Head</h1><p>{LONG}</p>{hidden}{end}{behind}</article>") == f"Head\n{LONG.strip()}\n{LONG}END", (hidden, behind)
    for name in "template svg object canvas audio video iframe noscript textarea".split():
        # Unclosed: hidden to the end of the element around it.
        assert main_text(f"<article><p>{LONG}<{name}>no</p>{end}</article>") == f"{LONG.strip()}\n{LONG}END", name
    assert main_text(f"<article>{end}<script>var a") == f"{LONG}END"
