"""Plain-Python answers for small tables, by going through every invoice, payment and day."""

from decimal import Decimal

ZERO = Decimal(0)


def rate_on(rates, day):
    """rates: {day: rate}; the last one at or before the day."""
    known = [d for d in rates if d <= day]
    return rates[max(known)] if known else None


def total(values):
    return sum((v for v in values if v is not None), ZERO)


def product(a, b):
    return None if a is None or b is None else a * b


def of_invoice(invoice, payments):
    number = invoice[0]
    return [p for p in payments if number is not None and p[0] == number]


def split(invoice, payments):
    date = invoice[2]
    mine = [p for p in of_invoice(invoice, payments) if p[1] is not None]
    return [p for p in mine if p[1] < date], [p for p in mine if p[1] >= date]


def gap(high, low):
    return None if high is None or low is None else high - low


def summary(invoices, payments, rates, as_of, spread=Decimal("0.02")):
    days = sorted(rates)
    now = rates[days[-1]]
    before = rates[days[-2]] if len(days) > 1 else now
    first_of_month = as_of.replace(day=1)
    closed = [d for d in days if d < first_of_month]
    month_end = rates[closed[-1]] if closed else now
    out = []
    for invoice in invoices:
        number, client, date, value = invoice
        if date is None:
            paid = total(p[2] for p in of_invoice(invoice, payments))
            out.append((number, client, None, value, None, paid, ZERO, max(value - paid, ZERO), *[ZERO] * 8))
            continue
        early, late = split(invoice, payments)
        own = rate_on(rates, date)
        own = now if own is None else own
        advance, later = total(p[2] for p in early), total(p[2] for p in late)
        balance = max(value - advance - later, ZERO)
        d_adv = total(product(gap(own, p[3]), p[2]) for p in early)
        d_real = total(product(gap(p[3], own), p[2]) for p in late)
        d_open = balance * (now - own)
        base = own if date >= first_of_month else month_end
        out.append((
            number, client, date, value, own, advance, later, balance, d_adv, d_real, d_open, balance * (now - base),
            d_adv + d_real + d_open, balance * (now - before), balance * (now * (1 + spread) - before),
            balance * (now * (1 - spread) - before),
        ))
    return out


def detail(invoices, payments, rates, newest_if_older=False):
    out = []
    for invoice in invoices:
        number, client, date, value = invoice
        if date is None:
            continue
        own = rate_on(rates, date)
        if own is None and newest_if_older:
            own = rates[max(rates)]
        early, late = split(invoice, payments)
        advance = total(p[2] for p in early)
        d_adv = None if own is None else total(product(gap(own, p[3]), p[2]) for p in early)
        for day in sorted(rates):
            if day < date:
                out.append((day, number, client, value, own, advance, ZERO, ZERO, ZERO, ZERO, ZERO, ZERO, rates[day]))
                continue
            done = [p for p in late if p[1] <= day]
            balance = max(value - advance - total(p[2] for p in done), ZERO)
            if own is None:
                d_real = d_open = all_ = None
            else:
                d_real = total(product(gap(p[3], own), p[2]) for p in done)
                d_open = balance * (rates[day] - own)
                all_ = d_adv + d_real + d_open
            out.append((day, number, client, value, own, advance, total(p[2] for p in done), balance, d_adv, d_real, d_open, all_, rates[day]))
    return out


def series(invoices, payments, rates):
    rows, out, last = detail(invoices, payments, rates), [], None
    for day in sorted(rates):
        today = [r for r in rows if r[0] == day]
        sums = [total(r[i] for r in today) for i in (7, 8, 9, 10)]
        change = ZERO if last is None else sums[3] - last
        last = sums[3]
        out.append((day, rates[day], *sums, sums[1] + sums[2] + sums[3], change))
    return out
