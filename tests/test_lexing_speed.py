"""Comments are passed over as a whole, also those that never end."""

from recall_spark.operators import lexing


def test_comments_are_not_matched_sign_by_sign(monkeypatch):
    """Before, a pattern went through a comment lazily (F7)."""
    seen = []

    class Counting:
        def __init__(self, pattern):
            self.pattern = pattern

        def match(self, text, at):
            m = self.pattern.match(text, at)
            seen.append(m.group())
            return m

    for language in lexing.LANGUAGES:
        monkeypatch.setitem(lexing._MATCH, language, Counting(lexing._MATCH[language]))
        words = [t.text for t in lexing.tokens("a /* x } y \n*/ b /*/ c */ d /* never", language)]
        assert words == (["a", "b", "d"]) and not any(s.startswith("/*") for s in seen)
