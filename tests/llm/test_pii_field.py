"""Operator 2: the field on lines written by hand, of forms and words that its training lines weren't made of."""

import random
import re
import time

import pytest

from sparkloom.llm import pii

#: Entities stand between << and >>, after their kind.
LINES = """
Reach Dana at <<phone|(212) 555-0187>> after five, or leave word with the porter.
Her <<ssn|078-05-1120>> is on file; the clerk retyped it as <<ssn|219-09-9999>> last spring.
For refunds phone <<phone|415-555-0199>> between 9 and 17 on weekdays.
Write to <<email|m.oduya (at) harbourmail.org>> or to <<email|lena[at]quietworks[dot]net>> before 2024-03-31.
The plumber (<<phone|646.555.0143>>) quoted 1,250.00 for 14 metres of pipe.
Ask <<email|kim (at) orchard dot org>> for the minutes of the 2019-11-04 meeting.
Toll free <<phone|1-800-555-0123>>, open 24 hours, ticket 88213.
Social security number <<ssn|457-55-5462>>, born 03/14/1961, height 172 cm.
Version 10.4.2 shipped on 12/01/2020 at 10:45:30 and fixed 312 of 1,024 bugs.
The parcel 4012888888881882345671 weighs 12.75 kg and costs 1.299,00 in total.
Pages 114-120 of volume 12, number 3 (1998) cover the years 1914-1918 and 1939-1945.
Latitude 52.5200 and longitude 13.4050 were measured at 08:15 on 07/22/2018.
Call me: <<phone|(030) 555-7788>> or the office, <<phone|303-555-0110>>, extension 12.
In 1865 about 4,000,000 people lived there; by 1900 it was 9,250,100.
ISBN 978-3-16-148410-0 is listed at 29.95 and ships in 3-5 days.
Employee 10442 has the social security number <<ssn|623-41-9087>>.
The score was 21-14, 18-21, 21-19 after 1:42:07 on court 7.
Mail <<email|info (at) northgate dot example>> and quote 2021/447.
My cell is <<phone|917-555-0166>>; the old one, <<phone|718-555-0101>>, is dead.
Room 204-B, building 17, floor 3, desk 12-4.
Contact <<email|j.ferrer [at] velomail dot com>> about invoice 7741-22.
Serial a93bd01f77c2 was sold with part 55-1023-9 on 2016-08-30.
Fax <<phone|(408) 555-0175>> or <<phone|408.555.0176>>; no calls after 18:30.
Between 12:00 and 13:30 the temperature rose from 21.5 to 27.25 degrees.
He scored 100 @ 12.5 each, and 40 @ 7.25, for 1540.00 in sum.
The claimant (SSN <<ssn|301-22-8841>>) phoned from <<phone|502-555-0134>> on 2022-02-02.
""".strip().split("\n")


def labelled(line):
    text, labels, at = "", [], 0
    for m in re.finditer(r"<<(\w+)\|(.*?)>>", line):
        text += line[at : m.start()]
        labels.append((pii.KINDS.index(m[1]), len(text), len(text) + len(m[2])))
        text += m[2]
        at = m.end()
    return text + line[at:], labels


@pytest.fixture(scope="module")
def field():
    return pii.field()


def test_lines_by_hand(field):
    right = found = true = 0
    for line in LINES:
        text, labels = labelled(line)
        got = {(k, a, b) for k, a, b, _ in pii.find_pii(text, field)}
        right, found, true = right + len(got & set(labels)), found + len(got), true + len(labels)
        if got != set(labels):
            print(text, [(pii.KINDS[k], text[a:b]) for k, a, b in sorted(got ^ set(labels))])
    print(right, found, true)
    assert right / found >= 0.9 and right / true >= 0.9


def numbers(n, seed):
    rng = random.Random(seed)
    return "".join(f"{rng.randrange(10 ** rng.randrange(1, 7))}" + rng.choice([" ", "-", ".", ", ", "(", "/"]) for _ in range(n))


def test_found_spans_dont_overlap(field):
    """Nor do they touch base spans, in texts that are one window from end to end."""
    for seed in range(30):
        t = numbers(150, seed) + " 10.1.2.3 a@b.org +1 555 010 9999 " + numbers(150, seed + 100)
        got = pii.find_pii(t, field)
        own = sorted((a, b) for _, a, b, base in got if not base)
        assert all(x[1] <= y[0] for x, y in zip(own, own[1:], strict=False))
        assert not any(a < y and x < b for a, b in own for _, x, y, base in got if base)


def test_together_as_alone(field):
    texts = [numbers(40, s) + "call 555-123-4567" for s in range(20)] + [None, "", "no numbers"]
    assert pii.find_all(texts, field) == [pii.find_pii(t, field) for t in texts]


def test_pieces_of_long_windows(field, monkeypatch):
    texts = [numbers(1500, s) + "call 555-123-4567 or 10.1.2.3, a@b.org " + numbers(1500, s + 50) for s in range(4)]
    whole = pii.find_all(texts, field)
    monkeypatch.setattr(pii, "LONG", 700)
    monkeypatch.setattr(pii, "LAP", 300)
    got = pii.find_all(texts, field)
    for a, b in zip(got, whole, strict=True):
        assert len(set(a) ^ set(b)) <= 2 and len(b) > 20  # near ties across a cut
        own = sorted((x, y) for _, x, y, base in a if not base)
        assert all(x[1] <= y[0] for x, y in zip(own, own[1:], strict=False))


def test_a_long_text_of_numbers(field):
    began = time.perf_counter()
    assert pii.find_pii(numbers(250_000, 1)[: 1 << 20], field)
    assert time.perf_counter() - began < 60
