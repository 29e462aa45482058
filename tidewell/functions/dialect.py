"""The few expressions that Spark SQL and DuckDB write differently. Operators are SQL in terms of these."""

from __future__ import annotations


class Spark:
    name = "spark"

    def r(self, x: str, n: int = 6) -> str:
        """x to n decimals, halves away from zero, by the whole number nearest to x times 10 to the n as DuckDB has it; Spark's round() goes by the digits that x is written with."""
        return f"(round(({x}) * 1e{n}, 0) / 1e{n})"

    def pct(self, x: str, p: float) -> str:
        """Exact percentile with linear interpolation."""
        return f"percentile({x}, {p})"

    def days(self, later: str, earlier: str) -> str:
        return f"CAST(datediff({later}, {earlier}) AS BIGINT)"

    def seconds(self, later: str, earlier: str) -> str:
        return f"CAST(timestampdiff(SECOND, {earlier}, {later}) AS BIGINT)"

    def plus(self, day: str, n: str | int) -> str:
        return f"date_add({day}, CAST({n} AS INT))"

    def sunday(self, day: str) -> str:
        """The Sunday that ends the week of day."""
        return f"date_add(CAST(trunc({day}, 'WEEK') AS DATE), 6)"

    def friday(self, day: str) -> str:
        """The first Friday from day on."""
        return f"next_day(date_sub({day}, 1), 'FR')"

    def month_start(self, day: str) -> str:
        return f"CAST(trunc({day}, 'MONTH') AS DATE)"

    def part(self, what: str, day: str) -> str:
        return f"CAST(extract({'YEAROFWEEK' if what == 'isoyear' else what} FROM {day}) AS BIGINT)"

    def last(self, x: str, over: str) -> str:
        """The last value that isn't null."""
        return f"last_value({x}, true) OVER ({over})"

    def listed(self, x: str, order: str | None = None) -> str:
        """Values joined by commas in order of the values, or of another expression."""
        if order is None:
            return f"array_join(sort_array(collect_list({x})), ',')"
        return f"array_join(transform(array_sort(collect_list(struct({order} AS o, {x} AS v))), e -> e.v), ',')"

    def json(self, text: str, field: str) -> str:
        return f"get_json_object({text}, '$.{field}')"

    def found(self, text: str, pattern: str, group: int = 1) -> str:
        return f"nullif(regexp_extract({text}, r'{pattern}', {group}), '')"

    def replaced(self, text: str, pattern: str, by: str) -> str:
        return f"regexp_replace({text}, r'{pattern}', '{by}')"

    def series(self, start: int | str, stop: int | str, name: str) -> str:
        """Rows of the integers from start to stop."""
        return f"(SELECT explode(sequence(CAST({start} AS BIGINT), CAST({stop} AS BIGINT))) AS {name})"

    def whole(self, a: str, b: str) -> str:
        """a / b without the rest, for whole numbers."""
        return f"CAST(({a}) div ({b}) AS BIGINT)"

    def hour(self, ts: str) -> str:
        return f"date_trunc('HOUR', {ts})"

    def local(self, ts: str, zone: str) -> str:
        """The time on the clocks of a zone at a moment of UTC, both without a zone."""
        return f"convert_timezone('UTC', '{zone}', CAST({ts} AS TIMESTAMP_NTZ))"

    def utc(self, ts: str, zone: str) -> str:
        """The moment of UTC at which the clocks of a zone show a time."""
        return f"convert_timezone('{zone}', 'UTC', CAST({ts} AS TIMESTAMP_NTZ))"

    def after(self, ts: str, minutes: str) -> str:
        """So many whole minutes after a time or the beginning of a day."""
        return f"(CAST({ts} AS TIMESTAMP_NTZ) + make_dt_interval(0, 0, CAST({minutes} AS INT)))"

    def bround(self, x: str, n: int) -> str:
        """Rounded half to even."""
        return f"bround({x}, {n})"

    def number(self, x: str) -> str:
        return f"try_cast({x} AS DOUBLE)"

    def date(self, x: str) -> str:
        """The day that a text tells; null if it is none."""
        return f"try_cast({x} AS DATE)"

    def split(self, x: str, by: str, k: int) -> str:
        """The k-th part of x, from 1."""
        return f"try_element_at(split({x}, '[{by}]'), {k})"

    def erfc(self, x: str) -> str:
        """The complementary error function of x >= 0, to 1.5e-7 (a rational approximation with fixed coefficients)."""
        t = f"(1 / (1 + 0.3275911e0 * ({x})))"
        return f"({t} * (0.254829592e0 + {t} * (-0.284496736e0 + {t} * (1.421413741e0 + {t} * (-1.453152027e0 + {t} * 1.061405429e0)))) * exp(-({x}) * ({x})))"

    def normal_cdf(self, x: str) -> str:
        """The share of a standard normal below x, to 1e-7."""
        half = self.erfc(f"abs({x}) / sqrt(2e0)") + " / 2"
        return f"CASE WHEN {x} >= 0 THEN 1 - {half} ELSE {half} END"

    def normal_inv(self, p: str) -> str:
        """The x below which a standard normal has the share p, to 1e-8 of x (a published rational approximation with fixed coefficients); null outside of (0, 1)."""
        a = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
        b = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
        c = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
        e = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)

        def poly(k: tuple[float, ...], x: str) -> str:
            return f"{k[0]:.15e}" if len(k) == 1 else f"({poly(k[:-1], x)} * {x} + {k[-1]:.15e})"

        def tail(p: str) -> str:
            q = f"sqrt(-2 * ln({p}))"
            return f"{poly(c, q)} / {poly(e, q)}"

        middle = f"(({p}) - 0.5e0)"
        square = f"({middle} * {middle})"
        return f"CASE WHEN {p} <= 0 OR {p} >= 1 THEN NULL WHEN {p} < 0.02425e0 THEN {tail(f'({p})')} WHEN {p} > 0.97575e0 THEN -{tail(f'(1 - ({p}))')} ELSE {poly(a, square)} * {middle} / {poly(b, square)} END"

    def digest(self, text: str) -> str:
        """A whole number of 48 bits that is mixed from text, the same in every engine."""
        return f"CAST(conv(substr(md5({text}), 1, 12), 16, 10) AS BIGINT)"

    def corr(self, x: str, y: str) -> str:
        """The correlation of pairs without a null; null where one of the two doesn't vary."""
        both = [f"CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL THEN {v} END" for v in (x, y)]
        return f"covar_samp({x}, {y}) / nullif(stddev_samp({both[0]}) * stddev_samp({both[1]}), 0)"

    def g1(self, x: str) -> str:
        """Skewness as pandas has it."""
        return f"skewness({x}) * sqrt(CAST(count({x}) AS DOUBLE) * (count({x}) - 1)) / nullif(count({x}) - 2, 0)"

    def g2(self, x: str) -> str:
        """Excess kurtosis as pandas has it."""
        n = f"CAST(count({x}) AS DOUBLE)"
        return f"({n} - 1) / nullif(({n} - 2) * ({n} - 3), 0) * (({n} + 1) * kurtosis({x}) + 6)"


class Duck(Spark):
    name = "duckdb"

    def r(self, x: str, n: int = 6) -> str:
        return f"round({x}, {n})"

    def pct(self, x: str, p: float) -> str:
        return f"quantile_cont({x}, {p})"

    def days(self, later: str, earlier: str) -> str:
        return f"date_diff('day', {earlier}, {later})"

    def seconds(self, later: str, earlier: str) -> str:
        return f"date_sub('second', {earlier}, {later})"

    def plus(self, day: str, n: str | int) -> str:
        return f"CAST(({day} + CAST({n} AS INTEGER)) AS DATE)"

    def sunday(self, day: str) -> str:
        return f"CAST(CAST(date_trunc('week', {day}) AS DATE) + 6 AS DATE)"

    def friday(self, day: str) -> str:
        return f"CAST({day} + CAST((12 - isodow({day})) % 7 AS INTEGER) AS DATE)"

    def month_start(self, day: str) -> str:
        return f"CAST(date_trunc('month', {day}) AS DATE)"

    def part(self, what: str, day: str) -> str:
        return f"CAST(extract({what} FROM {day}) AS BIGINT)"

    def last(self, x: str, over: str) -> str:
        return f"last_value({x} IGNORE NULLS) OVER ({over})"

    def listed(self, x: str, order: str | None = None) -> str:
        return f"string_agg(CAST({x} AS VARCHAR), ',' ORDER BY {order or x})"

    def json(self, text: str, field: str) -> str:
        return f"json_extract_string({text}, '$.{field}')"

    def found(self, text: str, pattern: str, group: int = 1) -> str:
        return f"nullif(regexp_extract({text}, '{pattern}', {group}), '')"

    def replaced(self, text: str, pattern: str, by: str) -> str:
        return f"regexp_replace({text}, '{pattern}', '{by}', 'g')"

    def series(self, start: int | str, stop: int | str, name: str) -> str:
        return f"(SELECT unnest(range({start}, {stop} + 1)) AS {name})"

    def whole(self, a: str, b: str) -> str:
        return f"CAST(({a}) // ({b}) AS BIGINT)"

    def hour(self, ts: str) -> str:
        return f"date_trunc('hour', {ts})"

    def local(self, ts: str, zone: str) -> str:
        return f"timezone('{zone}', timezone('UTC', CAST({ts} AS TIMESTAMP)))"

    def utc(self, ts: str, zone: str) -> str:
        return f"timezone('UTC', timezone('{zone}', CAST({ts} AS TIMESTAMP)))"

    def after(self, ts: str, minutes: str) -> str:
        return f"(CAST({ts} AS TIMESTAMP) + to_minutes(CAST({minutes} AS BIGINT)))"

    def bround(self, x: str, n: int) -> str:
        return f"round_even({x}, {n})"

    def split(self, x: str, by: str, k: int) -> str:
        return f"string_split({x}, '{by}')[{k}]"

    def digest(self, text: str) -> str:
        return f"CAST('0x' || substr(md5({text}), 1, 12) AS BIGINT)"

    def g1(self, x: str) -> str:
        return f"skewness({x})"

    def g2(self, x: str) -> str:
        return f"kurtosis({x})"
