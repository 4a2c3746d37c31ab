"""License templates reach to the end of their licences."""
import re

import pytest

from winnowry.llm import licenses

AUTOMATA = [licenses.compile_template(k, t) for k, t in licenses.TEMPLATES.items()]
CURL_END = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT OF THIRD PARTY RIGHTS. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY,
WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""


def text_of(label, holder):
    return re.sub(r"<<var[^>]*>>", holder, re.sub(r"<<(begin|end)Optional>>", "", licenses.TEMPLATES[label]))


def labels(text):
    return {x for x, _, _ in licenses.find_all(licenses.words_of(text.encode()), AUTOMATA)}


@pytest.mark.parametrize("label", ["text-mit", "text-isc"])
@pytest.mark.parametrize("holder", ["THE AUTHORS OR COPYRIGHT HOLDERS", "Internet Systems Consortium, Inc. (\"ISC\")"])
def test_whole_texts_only(label, holder):
    text = text_of(label, holder)
    assert labels("before " + text + " after") == {label}
    for old, new in (("BE LIABLE", "BE ACCOUNTABLE"), ("MERCHANTABILITY", "QUALITY"), ("IN CONNECTION WITH", "BY"), ("AS IS", "AS WAS")):
        assert old in text and labels(text.replace(old, new)) == set()
    for cut in ("WARRANT", "IN NO EVENT", "BE LIABLE"):
        assert labels(text[: text.rindex(cut)]) == set()
    assert labels(" ".join(text.split()[:-1])) == set()


def test_curl_is_not_isc():
    isc = text_of("text-isc", "THE AUTHOR")
    assert labels(isc) == {"text-isc"}
    assert labels(isc[: isc.index("THE SOFTWARE IS PROVIDED")] + CURL_END) == set()
