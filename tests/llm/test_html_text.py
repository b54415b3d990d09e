"""What the line-block distribution keeps of a page."""

from tidemark.llm.html_text import main_text, stretches

LONG = "Words of a sentence that goes on for a while, so that a window of lines has weight. "


def p(*texts):
    return "".join(f"<p>{t}</p>" for t in texts)


def test_windows_choose_beside_articles():
    main = [(LONG * 3).strip(), (LONG * 2).strip()]
    page = f"<body><article>{p('Teaser one')}</article><article>{p('Teaser two')}</article><div>{p(*main)}</div></body>"
    assert main_text(page) == "\n".join(["Teaser one", "Teaser two", *main])


def test_text_without_a_surge_is_left_out():
    page = "<body><div><p>We are here</p></div>" + "<nav><p>x</p><p>x</p><p>x</p></nav>" + f"<div>{p(LONG, LONG)}</div></body>"
    assert main_text(page) == "\n".join([LONG.strip()] * 2)
    assert main_text(f"<body><div>{p('We are here')}</div><section>{p('Short', 'text')}</section></body>") == "We are here\nShort\ntext"
    assert stretches([0, 90, 0, 0, 0, 5]) == [(0, 2, True), (3, 6, False)]


ADVERTS = '<ul class="promo"><li>Buy</li><li>Buy</li><li>Buy</li></ul>'


def test_short_tail_of_a_long_page():
    page = f"<body><div>{p(*[LONG] * 500)}{ADVERTS}{p('The end.')}</div></body>"
    assert main_text(page).split("\n")[-2:] == [LONG.strip(), "The end."]
    page = f"<body><div><section>{p(*[LONG] * 500)}</section>{ADVERTS}<section>{p('The end.')}</section></div></body>"
    assert main_text(page).split("\n")[-1] == "The end."


def test_paragraphs_of_links():
    references = ", ".join(f"Author {i}, <a href=x>{LONG}</a>" for i in range(9))
    page = f"<body><div>{p(LONG, LONG, '<a>Read this as well</a>', LONG, references)}</div><ul><li><a>Home</a><li><a>News</a></ul></body>"
    got = main_text(page).split("\n")
    assert len(got) == 5 and got[2] == "Read this as well" and got[4].startswith("Author 0, Words")


def test_marks_within_the_article():
    page = f'<article><h2 id="related-work">Related work</h2><p id="notice-to-readers">{LONG}</p><table class="share-prices"><tr><td>12</table><div class="share">Tweet</div></article>'
    assert main_text(page).split("\n") == ["Related work", LONG.strip(), "12"]
    assert main_text(f'<body><h2 id="related-work">Related work</h2><p id="legal">{LONG}</p></body>').split("\n") == ["Related work", LONG.strip()]


def test_head_without_an_end():
    for start in ("<html><head><title>T</title>", "<head><meta charset=utf-8><style>p{}</style><script>'<p>no</p>'</script>"):
        assert main_text(f"{start}<p>{LONG}</p>") == LONG.strip()
        assert main_text(f"{start}{LONG}") == LONG.strip()
        assert main_text(f"{start}<body><p>{LONG}</p>") == LONG.strip()


def test_what_is_hidden_or_a_control_is_no_part_of_a_line():
    page = f'<div>{p(LONG)}<p>Price <span style="display:none">secret</span> now <span hidden>h</span></p><p>q <button>no</button> r</p>'
    page += f'<p>a</p><label>Your name</label><button>Send</button><p>b <span class="share">c</span></p>{p(LONG)}</div>'
    assert main_text(page).split("\n") == [LONG.strip(), "Price now", "q r", "a", "b c", LONG.strip()]
    assert main_text(f"<div>{p(LONG)}<p><span aria-hidden=true>no</span></p></div>") == LONG.strip()


def test_additions_within_the_article():
    inner = f'<p class="comment">me too</p><p class="advert">Buy</p><div class="related-posts">More</div><div class="share-box">Tweet</div><p class="lead comment-free">{LONG}</p>'
    inner += f'<div class="discussion">{p("We discuss.")}</div><div class="related-work">{p("Others.")}</div><p class="share-prices">up</p>'
    assert main_text(f"<article>{p(LONG)}{inner}</article>").split("\n") == [LONG.strip(), LONG.strip(), "We discuss.", "Others.", "up"]


def test_a_closing_section_beside_the_text_stays():
    assert main_text(f"<body><div>{p(LONG, LONG)}</div><section>{p('The end.')}</section></body>").split("\n")[-1] == "The end."


def test_windows_alone_drop_what_is_weak_beside_an_article(monkeypatch):
    from tidemark.llm import html_text

    monkeypatch.setattr(html_text, "_marked", lambda *a: False)
    page = f'<ul><li><a href=x>Home</a><li><a href=y>News</a></ul><div>Buy this now</div><article>{p("Title", LONG, "Short.")}</article><div>(c) somebody</div>'
    assert main_text(page).split("\n") == ["Title", LONG.strip(), "Short."]
    beside = page.replace("(c) somebody", LONG * 2)
    assert main_text(beside).split("\n") == ["Title", LONG.strip(), "Short.", (LONG * 2).strip()]


def test_a_page_of_short_lines_surges_by_its_own_measure():
    page = f"<body><div>{p('One two three.')}</div><nav>{p('a', 'b', 'c')}</nav><div>{p('Four.')}</div></body>"
    assert main_text(page) == "One two three.\nFour."


def slow_stretches(weights, window, surge, dive):
    """Each line's window by itself; a stretch is a longest run of lines whose windows do not dive."""
    sums = [sum(weights[i : i + window]) for i in range(len(weights))]
    holds = [i for i, s in enumerate(sums) if s >= dive]
    runs = []
    for i in holds:
        if runs and runs[-1][-1] == i - 1:
            runs[-1].append(i)
        else:
            runs.append([i])
    return [(r[0], r[-1] + 1, any(sums[i] >= surge for i in r)) for r in runs]


def test_stretches_by_brute_force():
    import random

    random.seed(6)
    for _ in range(500):
        weights = [random.choice([0, 0, 0, 5, 40, 90]) for _ in range(random.randint(0, 30))]
        window, surge, dive = random.randint(1, 4), random.randint(1, 150), random.randint(1, 30)
        assert stretches(weights, window, surge, dive) == slow_stretches(weights, window, surge, dive)
