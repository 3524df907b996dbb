"""Main text in languages without known stop words, and blocks without any."""

import pytest

from recordmill.llm.html_main import main_text

CHINESE = "中国银行保险监督管理委员会对某公司的违法行为进行了调查、审理，并依法向当事人告知了作出行政处罚的事实、理由、依据及当事人依法享有的权利。"
POLISH = "Wczoraj wieczorem mieszkańcy miasta zebrali się przed ratuszem, aby wspólnie świętować otwarcie nowego mostu nad rzeką, którego budowa trwała ponad trzy lata."
ENGLISH = "The committee met in the town hall on Monday and it was agreed that the bridge would be closed for the whole of the summer, as it is not safe."
MENU = '<ul><li><a href="/">Home</a></li><li><a href="/a">About</a></li></ul><nav>menu</nav>'


@pytest.mark.parametrize("text", [CHINESE, POLISH, ENGLISH])
def test_plain_pages_of_any_language(text):
    page = f"<html><body>{MENU}<div><p>{text}</p><p>{text}</p></div><footer>{text}</footer></body></html>"
    assert main_text(page) == f"{text}\n{text}"


def test_blocks_without_stop_words_between_good_ones():
    code = " ".join(f"x{i} = f{i}(y{i});" for i in range(30))
    page = f"<div><p>{ENGLISH}</p><pre>{code}</pre><p>{ENGLISH}</p><p>{CHINESE}</p><p>{ENGLISH}</p></div>"
    assert main_text(page).split("\n") == [ENGLISH, code, ENGLISH, CHINESE, ENGLISH]


def test_nothing_but_links_stays_empty():
    assert main_text(MENU) == "" and main_text(f'<div class="cookie"><a href="/">{POLISH}</a></div>') == ""
