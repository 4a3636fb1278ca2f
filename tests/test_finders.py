"""Mobile numbers, names after titles and addresses, without Spark."""

import time

import pytest

from veilframe.operators import finders

ADDRESSES = {
    # behind a label
    "Address: 7 Lake View, Pune": ["7 Lake View, Pune"],
    "my address is at 21B Temple Street, Mysuru": ["21B Temple Street, Mysuru"],
    "Postal Address of the payee: Plot 9, Sector 4, Noida": ["Plot 9, Sector 4, Noida"],
    "Addresses - 4 Hill Road, Ooty": ["4 Hill Road, Ooty"],
    "Address | 88 Beach Road, Chennai": ["88 Beach Road, Chennai"],
    "Address | GSTIN | 88 Beach Road, Chennai": ["88 Beach Road, Chennai"],
    "Address: 7 Lake View,\nWard 3,\n  Pune\nPhone 1": ["7 Lake View,\nWard 3,\n  Pune"],
    "Address: 5 Cross Lane near the lake. Please ring twice": ["5 Cross Lane near the lake"],
    "Address: Opp. Bus Depot, Dist. Wardha, No. 4": ["Opp. Bus Depot, Dist. Wardha, No. 4"],
    "## Permanent Address\n14 Mill Road\nNear the tank\n\nrest": ["14 Mill Road\nNear the tank"],
    "Address:\n- Flat 2, Rose Court\n- Kochi\n": ["Flat 2, Rose Court\n- Kochi"],
    "Address\n" + "\n".join(f"Line {k}" for k in range(9)): ["Line 0\nLine 1\nLine 2\nLine 3\nLine 4"],
    "Address: same": [], "Address: the same as before": [], "Please address this issue, number 12.": [], "E-mail address: box 12, somewhere": [], "IP address is 10, 20 or 30": [],
    "the address-book: 12, 13": [], "web address - 12 pages, long": [], "Address of " + "x" * 60 + ": 12 Some Road, X": [],
    # by a PIN
    "Please courier it to 3 Park Lane, Andheri, Mumbai 400053 today": ["3 Park Lane, Andheri, Mumbai 400053"],
    "3 Park Lane, Andheri, Mumbai - 400 053, Maharashtra": ["3 Park Lane, Andheri, Mumbai - 400 053, Maharashtra"],
    "I live at Flat 3, Near City Hospital, Nagpur 440001": ["Flat 3, Near City Hospital, Nagpur 440001"],
    "one two three four five six seven eight, Pune 411001": ["three four five six seven eight, Pune 411001"],
    "ship - 3 Park Lane, Mumbai 400053": ["3 Park Lane, Mumbai 400053"],
    "NAGPUR - 440001": ["NAGPUR - 440001"], "my pin code is 440001": ["440001"], "PIN: 440 001": ["440 001"], "Pincode no. 440001": ["440001"],
    "NEFT - 440001": [], "Total, and the fee is 450000": [], "Balance, Amount 12,400053": [], "Balance, Amount 400053,00": [], "Balance, closing 0400053": [], "Ref, Mumbai 4000531": [],
}
NAMES = {
    "Mr. Arjun Mehta called": ["Arjun Mehta"], "SMT K L RADHA DEVI SAVINGS": ["K L RADHA DEVI"], "dr. A.P.J. Menon": ["A.P.J. Menon"], "Shri Arjun K. Mehta Rao Patil": ["Arjun K. Mehta Rao"], "MRS RADHA K W/O X": ["RADHA K"],
    "Mr Mehta's bag": ["Mehta's"], "Kumari Anita D'Souza-Rao": ["Anita D'Souza-Rao"], "DR NEFT 500": [], "Ms Word": [], "mr mehta": [], "Mr. A": [], "Mr the Account": [], "MR ACCOUNT HOLDER": [], "Miss\nRadha": [], "Mr. R 5": [],
}
MOBILES = {
    "9812345678": ["9812345678"], "98123 45678": ["98123 45678"], "+91-98123-45678": ["+91-98123-45678"], "0 9812345678": ["9812345678"], "09812345678": ["09812345678"], "919812345678.": ["919812345678"],
    "call 91 9812345678, 7812345678": ["91 9812345678", "7812345678"], "Rs 1,9812345678": [], "9812345678.5": [], "X9812345678": [], "/9812345678": [], "5812345678": [], "98123456789": [], "98123  45678": [], "9812 345678": [],
}


def _found(finder, text):
    return [text[s:e] for s, e, _ in sorted(finder(text))]


@pytest.mark.parametrize("text", list(ADDRESSES))
def test_addresses(text):
    found = {x for f in (finders.labelled_addresses, finders.pin_addresses) for x in _found(f, text)}
    assert found == set(ADDRESSES[text])


@pytest.mark.parametrize("text", list(NAMES))
def test_names(text):
    assert _found(finders.titled_names, text) == NAMES[text]


@pytest.mark.parametrize("text", list(MOBILES))
def test_mobiles(text):
    assert _found(finders.mobiles, text) == MOBILES[text]


@pytest.mark.parametrize("piece", ["Address: 1, ", "Mr. ", "98123 ", "a, b, C 400053 ", "address of ", "1 ", "x-", "Address\n", ", ", "Address | "])
def test_time_grows_with_the_text(piece):
    for finder in (finders.labelled_addresses, finders.pin_addresses, finders.titled_names, finders.mobiles):
        began = time.time()
        finder(piece * 5_000)
        assert time.time() - began < 5
