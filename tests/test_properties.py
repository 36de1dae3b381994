"""Property tests (hypothesis): batch forms agree with the state machines."""

from decimal import Decimal

import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from agora.functions.text import chunk_spans, split_text
from agora.streaming import alerts as S

DAY = 86_400_000

events = st.lists(st.tuples(st.sampled_from(["a", "b", "c"]), st.integers(1, 900), st.integers(0, 40),
                            st.integers(0, 86_399_999)), min_size=1, max_size=60)


class _State:
    exists = False
    hasTimedOut = False

    def update(self, v):
        self.v = v


def _reference(rows, window, threshold):
    """The rule, one event after the other, in exact cents."""
    buckets, last, out = {}, {}, []
    for u, amount, ms, _ in rows:
        day, own = ms // DAY, buckets.setdefault(u, {})
        own[day] = own.get(day, 0) + int(amount * 100)
        for d in [d for d in own if d < day - window]:
            del own[d]
        inside = [c for d, c in own.items() if d <= day]
        total = sum(inside)
        if total < threshold * 100:
            last[u] = None
        elif last.get(u) is None or abs(total - last[u]) > 1:
            last[u] = total
            out.append((u, total, len(inside), ms))
    return sorted(out)


def _state_machine(rows, window, threshold):
    fn = S._rolling_state(window, int(threshold * 100), False)
    out = []
    pdf = pd.DataFrame([(u, int(a * 100), ms, i, ms) for u, a, ms, i in rows],
                       columns=["user_id", "cents", "event_time_ms", "offset", "arrived_ms"])
    for u, g in pdf.groupby("user_id"):
        for o in fn((u,), iter([g]), _State()):
            out += [(x.user_id, int(x.cents), int(x.bucket_count), int(x.event_time_ms)) for x in o.itertuples()]
    return sorted(out)


# Amounts of some cents make chains of small steps, in which the last alerted total decides.
small_events = st.lists(st.tuples(st.sampled_from(["a", "b"]), st.sampled_from([0, 1, 1, 1, 2, 3, 150, 100_000]), st.integers(0, 12),
                                  st.integers(0, 86_399_999)), min_size=1, max_size=80)


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.one_of(events, small_events), st.sampled_from([3, 7, 30]), st.sampled_from([1, 500, 900]))
def test_rolling_alert_batch_equals_rule(spark, evs, window, threshold):
    rows = sorted(((u, Decimal(c) / 100, d * DAY + ms, i) for i, (u, c, d, ms) in enumerate(evs)), key=lambda r: (r[2], r[3]))
    df = spark.createDataFrame(rows, "user_id string, amount decimal(12,2), event_time_ms long, tie long")
    batch = sorted((r.user_id, int(r.total_amount * 100), r.bucket_count, int(r.ms)) for r in S.rolling_alert(
        df, window_days=window, threshold=threshold).withColumn("ms", F.unix_millis(F.col("detected_at").cast("timestamp_ltz"))).collect())
    assert batch == _reference(rows, window, threshold)


@settings(max_examples=150, deadline=None)
@given(st.one_of(events, small_events), st.sampled_from([3, 7, 30]), st.sampled_from([1, 500, 900]))
def test_rolling_state_equals_rule_in_any_order_of_arrival(evs, window, threshold):
    """Late events included: arrival order is that of the list, not of time."""
    rows = [(u, Decimal(c) / 100, d * DAY + ms, i) for i, (u, c, d, ms) in enumerate(evs)]
    assert _state_machine(rows, window, threshold) == _reference(rows, window, threshold)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab \n")), max_size=4000))
def test_chunks_bounded_and_ordered(text):
    chunks = split_text(text)
    assert all(0 < len(c) <= 1000 for c in chunks)
    assert all(c == c.strip() for c in chunks)
    # the chunks, without their overlaps, spell the text's non-space content
    out, done = "", 0
    for a, b in chunk_spans(text):
        out += text[max(a, done):b]
        done = max(done, b)
    assert "".join(out.split()) == "".join(text.split())
