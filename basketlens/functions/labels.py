"""Label values that are data and must match the reference verbatim.

Fixed values (reference output text, kept as given):

* weekday names, order_dow 0..6:
  Sunday, Monday, Tuesday, Wednesday, Thursday, Friday, Saturday
* time periods by order_hour_of_day: 6-11 'Morning (6-11am)',
  12-17 'Afternoon (12-5pm)', 18-21 'Evening (6-9pm)', otherwise
  'Night (10pm-5am)' (a null hour falls to 'Night (10pm-5am)')
* day type: order_dow 0 or 6 'Weekend', otherwise 'Weekday' (null -> 'Weekday')
* basket size classes by distinct items: <= 5 'Small (1-5 items)',
  <= 15 'Medium (6-15 items)', <= 30 'Large (16-30 items)',
  otherwise 'XLarge (30+ items)'
* loyalty types: 'Same Department Loyalty', 'Cross Department Loyalty',
  'Multi-Product Loyalty'
* association label separators: ' → ' for pairs, ' + ' for larger sets;
  context label: day type, ' - ', time period
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WEEKDAYS = ["Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday"]

MORNING = "Morning (6-11am)"
AFTERNOON = "Afternoon (12-5pm)"
EVENING = "Evening (6-9pm)"
NIGHT = "Night (10pm-5am)"
WEEKEND = "Weekend"
WEEKDAY = "Weekday"

SMALL = "Small (1-5 items)"
MEDIUM = "Medium (6-15 items)"
LARGE = "Large (16-30 items)"
XLARGE = "XLarge (30+ items)"
SIZE_CLASSES = [SMALL, MEDIUM, LARGE, XLARGE]

SAME_DEPT = "Same Department Loyalty"
CROSS_DEPT = "Cross Department Loyalty"
MULTI = "Multi-Product Loyalty"

PAIR_ARROW = " → "
SET_PLUS = " + "
CONTEXT_SEP = " - "


def weekday_name(dow) -> Column:
    dow = F.col(dow) if isinstance(dow, str) else dow
    expr = None
    for i, name in enumerate(WEEKDAYS):
        expr = (F.when(dow == i, F.lit(name)) if expr is None
                else expr.when(dow == i, F.lit(name)))
    return expr


def time_period(hour) -> Column:
    h = F.col(hour) if isinstance(hour, str) else hour
    return (F.when(h.between(6, 11), F.lit(MORNING))
            .when(h.between(12, 17), F.lit(AFTERNOON))
            .when(h.between(18, 21), F.lit(EVENING))
            .otherwise(F.lit(NIGHT)))


def day_type(dow) -> Column:
    d = F.col(dow) if isinstance(dow, str) else dow
    return F.when(d.isin(0, 6), F.lit(WEEKEND)).otherwise(F.lit(WEEKDAY))


def size_class(items) -> Column:
    k = F.col(items) if isinstance(items, str) else items
    return (F.when(k <= 5, F.lit(SMALL)).when(k <= 15, F.lit(MEDIUM))
            .when(k <= 30, F.lit(LARGE)).otherwise(F.lit(XLARGE)))


def size_class_rank(label) -> Column:
    c = F.col(label) if isinstance(label, str) else label
    return (F.when(c == SMALL, 1).when(c == MEDIUM, 2).when(c == LARGE, 3).otherwise(4))


def association_label(names) -> Column:
    """' → ' between the two members of a pair, ' + ' between members of larger sets."""
    cols = [F.col(c) if isinstance(c, str) else c for c in names]
    return F.concat_ws(PAIR_ARROW if len(cols) == 2 else SET_PLUS, *cols)
