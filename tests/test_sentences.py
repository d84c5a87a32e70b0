"""The sentences of all views."""

from touchline.plans import QUERIES


def test_sentences_read_the_events_once(spark):
    """All views share what one pass stored; each used to read and order the events for itself."""
    d = QUERIES["summary_sentences"](spark, "/root/testdata/sf0.001")
    assert not [f for f in d.inputFiles() if "events" in f]
    broken = QUERIES["line_break_summary"](spark, "/root/testdata/sf0.001").count()
    assert {r.view for r in d.select("view").distinct().collect()} == {"attack", "time", "gaps", "chances", *(["lb"] if broken else [])}
