"""Properties over generated inputs, without Spark."""

from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from terraloom.operators import nested, ordering, regions, timestamps

ZONES = ["Europe/Berlin", "America/New_York", "Australia/Lord_Howe", "Asia/Kolkata", "America/St_Johns", "Pacific/Auckland"]
SECONDS = st.integers(0, 4_000_000_000)


@settings(max_examples=300, deadline=None)
@given(SECONDS, st.sampled_from(ZONES))
def test_local_times_follow_the_tz_database(seconds, name):
    """fold=0 is the earlier of two instants, and the offset before a gap: what Python's zones do, too."""
    local = datetime(1970, 1, 1) + timedelta(seconds=seconds)
    want = int(local.replace(tzinfo=ZoneInfo(name), fold=0).astimezone(timezone.utc).timestamp())
    assert timestamps.zone_table(name).to_utc(np.array([seconds]))[0] == want


@settings(max_examples=200, deadline=None)
@given(SECONDS, st.integers(-720, 840), st.sampled_from(["%Y:%m:%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S", "%d.%m.%Y %H:%M:%S", "%B %d, %Y %I:%M:%S %p", "%Y%m%d%H%M%S"]))
def test_formats_come_back(seconds, minutes, layout):
    t = datetime.fromtimestamp(seconds, timezone(timedelta(minutes=minutes)))
    text = t.strftime(layout) + (f" {'-' if minutes < 0 else '+'}{abs(minutes) // 60:02d}:{abs(minutes) % 60:02d}" if "%p" not in layout else "")
    got = timestamps.to_utc_micros([text], [None], ["UTC"])[0]
    assert got == (seconds + (minutes * 60 if "%p" in layout else 0)) * 1_000_000


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_any_text_is_read_or_left(text):
    timestamps.to_utc_micros([text], [text], ["Europe/Berlin"])


@settings(max_examples=100, deadline=None)
@given(st.integers(3, 12), st.integers(0, 10_000))
def test_ear_clipping_of_stars(n, seed):
    rng = np.random.default_rng(seed)
    a = np.sort(rng.uniform(0, 2 * np.pi, n))
    if len(np.unique(a)) < n or np.max(np.diff(np.append(a, a[0] + 2 * np.pi))) >= np.pi:
        return
    ring = np.column_stack([np.cos(a), np.sin(a)]) * rng.uniform(0.3, 1, (n, 1))
    area = lambda r: 0.5 * abs((r[:, 0] * np.roll(r[:, 1], -1) - r[:, 1] * np.roll(r[:, 0], -1)).sum())
    t = regions.ear_clip(ring)
    assert len(t) == n - 2 and np.isclose(sum(map(area, t)), area(ring))


JSON = st.recursive(st.none() | st.booleans() | st.integers(-5, 5) | st.text(max_size=3), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=3), x, max_size=3), max_leaves=12)


@settings(max_examples=200, deadline=None)
@given(JSON, JSON)
def test_identities_are_equal_only_for_equal_values(a, b):
    if isinstance(a, (dict, list)) and isinstance(b, (dict, list)):
        same = nested.shred_value(a)[-1][5] == nested.shred_value(b)[-1][5]
        strict = lambda v: (type(v).__name__, {k: strict(x) for k, x in v.items()} if isinstance(v, dict) else [strict(x) for x in v] if isinstance(v, list) else v)
        assert same == (strict(a) == strict(b))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(), max_size=8), max_size=5))
def test_interleaving_keeps_every_list_in_order(lists):
    tagged = [[(k, i) for i in range(len(x))] for k, x in enumerate(lists)]
    out = ordering.interleave(tagged)
    assert sorted(out) == sorted(x for t in tagged for x in t)
    assert all([x for x in out if x[0] == k] == t for k, t in enumerate(tagged))
