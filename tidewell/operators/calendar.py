"""The days on which the market is open, by a table of holidays and the year in which each began."""

from __future__ import annotations

from tidewell.plans.compose import relation

#: Name, kind, month, number, first and last year. Fixed: that day of the month, moved from a Saturday to Friday and from a
#: Sunday to Monday. Monday and Thursday: the so-manieth of the month, -1 the last. Easter: so many days after it.
HOLIDAYS = [
    ("new year", "fixed", 1, 1, 0, 9999),
    ("king", "monday", 1, 3, 1998, 9999),
    ("presidents", "monday", 2, 3, 0, 9999),
    ("good friday", "easter", 0, -2, 0, 9999),
    ("memorial", "monday", 5, -1, 1971, 9999),
    ("juneteenth", "fixed", 6, 19, 2022, 9999),
    ("independence", "fixed", 7, 4, 0, 9999),
    ("labor", "monday", 9, 1, 0, 9999),
    ("thanksgiving", "thursday", 11, 4, 0, 9999),
    ("after thanksgiving", "day after", 11, 4, 0, 9999),
    ("christmas", "fixed", 12, 25, 0, 9999),
]


def easter(d, years: str) -> str:
    """SELECT year, easter (its day) of SELECT year: the Gregorian computus, step by step."""
    w = d.whole
    first = f"SELECT year, year % 19 AS a, {w('year', '100')} AS b, year % 100 AS c FROM ({years}) y0"
    moon = f"SELECT *, (19 * a + b - {w('b', '4')} - {w(f'b - {w("b + 8", "25")} + 1', '3')} + 15) % 30 AS h FROM ({first}) y1"
    week = f"SELECT *, (32 + 2 * (b % 4) + 2 * {w('c', '4')} - h - c % 4) % 7 AS l FROM ({moon}) y2"
    day = f"SELECT year, h + l - 7 * {w('a + 11 * h + 22 * l', '451')} + 114 AS n FROM ({week}) y3"
    return f"SELECT year, make_date(CAST(year AS INT), CAST({w('n', '31')} AS INT), CAST(n % 31 + 1 AS INT)) AS easter FROM ({day}) y4"


def holiday_rows(d, days: str) -> str:
    """SELECT of year, name, day: the holidays of the years of SELECT day, and of the years next to them."""
    year = d.part("year", "day")
    years = f"SELECT DISTINCT year + o AS year FROM (SELECT DISTINCT {year} AS year FROM ({days}) x0) x CROSS JOIN {d.series(-1, 1, 'o')} y"
    table = ", ".join(f"('{name}', '{kind}', {month}, {n}, {since}, {until})" for name, kind, month, n, since, until in HOLIDAYS)
    start = "make_date(CAST(year AS INT), CAST(greatest(month, 1) AS INT), 1)"
    left = lambda x: d.days(d.sunday(x), x)  # noqa: E731  days to the Sunday that ends its week: Monday 6, Thursday 3, Saturday 1
    fixed = d.plus(start, "n - 1")
    moved = f"CASE {left(fixed)} WHEN 1 THEN {d.plus(fixed, -1)} WHEN 0 THEN {d.plus(fixed, 1)} ELSE {fixed} END"
    nth = lambda weekday: d.plus(start, f"({left(start)} - {6 - weekday} + 7) % 7 + 7 * (n - 1)")
    end = d.plus(f"make_date(CAST(year AS INT), CAST(least(month + 1, 12) AS INT), 1)", -1)
    last = d.plus(end, f"-((6 - {left(end)}) % 7)")
    day = f"""CASE kind WHEN 'fixed' THEN {moved} WHEN 'monday' THEN CASE WHEN n > 0 THEN {nth(0)} ELSE {last} END
      WHEN 'thursday' THEN {nth(3)} WHEN 'day after' THEN {d.plus(nth(3), 1)} ELSE {d.plus('easter', 'n')} END"""
    every = f"SELECT e.year, name, {day} AS day FROM ({easter(d, years)}) e JOIN (VALUES {table}) AS t(name, kind, month, n, since, until_) ON e.year BETWEEN since AND until_"
    return f"SELECT year, name, day FROM ({every}) q WHERE NOT (name = 'new year' AND {d.part('year', 'day')} < year)"


@relation("bench_close")
def holidays(d):
    """year, name, day of every holiday of the years of the days at hand, and of the years next to them.

    A fixed day moves to the nearest weekday, but New Year's isn't taken on the Friday that ends a year.
    """
    return holiday_rows(d, "SELECT day FROM bench_close")


@relation("bench_close", "holidays", covers="FIL-12")
def open_days(d):
    """Whether the market is open on each day, and the holiday it is closed for. The short day after Thanksgiving counts as a holiday."""
    return f"""SELECT b.day, CASE WHEN {d.days(d.sunday('b.day'), 'b.day')} <= 1 THEN 'weekend' WHEN h.day IS NOT NULL THEN 'holiday' ELSE 'open' END AS status, h.name AS holiday
FROM bench_close b LEFT JOIN holidays h ON h.day = b.day"""
