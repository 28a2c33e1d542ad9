"""Unit spellings, reason and metric texts, product grades, source priority."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, functions as F

# Fixed values - the unit spellings of the source files and the canonical names they stand for.
UNIT_SPELLINGS = {
    "°С": "degC",
    "°C": "degC",
    "кг/м3": "kg/m3",
    "% об.": "vol%",
    "% масс.": "mass%",
    "мг/кг": "mg/kg",
    "ppm": "ppm",
    "ед.цет.ч.": "cetane_number",
    "мм2/с": "mm2/s",
    "кПа": "kPa",
    "МПа": "MPa",
    "тыс.м3/ч": "thousand_m3/h",
    "м3/ч": "m3/h",
    "т/ч": "t/h",
    "Nm3/h": "Nm3/h",
    "Нм3/ч": "Nm3/h",
    "нм3/ч": "Nm3/h",
    "%": "%",
}

# Fixed values - what each reason code says to the reader.
REASON_TEXT = {
    "QUALITY_LIMIT": "ограничение качества не выполнено",
    "MISSING_REQUIRED_SIGNAL": "нет обязательного показателя качества",
    "UNASSESSED_REQUIRED_PROPERTY": "обязательное свойство смеси не оценено",
    "UNCERTAINTY_UNAVAILABLE": "нет консервативной оценки качества",
    "COMPONENT_STOCK": "недостаточный запас компонента",
    "ADDITIVE_LIMIT": "превышена допустимая доля присадки",
    "ADDITIVE_STOCK": "недостаточный запас присадки",
    "NO_FEASIBLE_CANDIDATE": "нет смеси, проходящей все проверки",
    "BASELINE_INFEASIBLE": "текущая рецептура не проходит ограничения",
    "NO_MATERIAL_IMPROVEMENT": "существенного улучшения не найдено",
    "MATERIAL_IMPROVEMENT": "найдено существенное модельное улучшение",
    "ACTION_COOLDOWN": "повторное изменение временно ограничено",
    "ACTION_MODEL_UNAVAILABLE": "невозможно оценить эффект реального действия",
    "ACTION_EFFECT_VALIDATION_FAILED": "модель эффекта действия не прошла проверку",
    "RELIABILITY_UNAVAILABLE": "надёжность оценки не подтверждена",
    "FORECAST_UNAVAILABLE": "нет применимого прогноза серы",
    "OUT_OF_DOMAIN": "условия вне проверенной области модели",
    "OOD": "условия вне проверенной области модели",
    "UNIT_MISMATCH": "единицы измерения не совпадают",
    "STALE_REQUIRED_SIGNAL": "обязательные данные устарели",
    "APPLICABILITY_UNAVAILABLE": "применимость модели не подтверждена",
    "RISK_MODEL_UNAVAILABLE": "оценка риска недоступна",
    "CRITERION_UNAVAILABLE": "критерий выбора не рассчитан",
    "QUALITY_LIMIT_VIOLATION": "превышен предел качества",
    "CURRENT_SULFUR_LIMIT": "текущая сера превышает предел",
    "EXCEEDANCE_PROBABILITY_THRESHOLD": "вероятность превышения выше порога",
    "ACTION_DELTA_OUT_OF_OBSERVED_RANGE": "изменение вне наблюдавшегося диапазона",
    "SULFUR_UPPER_LIMIT_60M": "верхняя оценка серы через час превышает предел",
}
UNKNOWN_REASON = "требуется дополнительная техническая проверка"
NO_REASON = "не указана"

# Fixed values - names of the ranked metrics.
METRIC_TEXT = {
    "sulfur": "сера",
    "t95": "T95",
    "cetane_number": "цетановое число",
    "risk_index": "индекс риска",
    "cost_proxy": "стоимостной индекс",
    "throughput": "производительность",
}

# Fixed values - limits by product grade: cetane lower, density lower, density upper.
GRADE_LIMITS = {
    "hds_diesel": (None, 820.0, 845.0),
    "summer_diesel": (51.0, 820.0, 845.0),
    "winter_diesel": (49.0, 800.0, 845.0),
}

# Fixed values - which source wins a snapshot, and how long its reading stays fresh (minutes).
SOURCE_PRIORITY = {"lims": 0, "pak": 1, "vak": 2, "telemetry": 3, "scenario": 4}
FRESH_MINUTES = {"telemetry": 20, "pak": 30, "lims": 2880}

# Fixed values - namespaces of the two installations.
STAGE_OF_NAMESPACE = {"АВТ": "avt", "avt": "avt", "24-2000": "ht", "Гидроочистка": "ht", "ht": "ht"}


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(values.items())])


def lookup(values: dict, key: Column, default: Column) -> Column:
    """Fixed small dictionary as a map literal: no join, no broadcast."""
    return F.coalesce(F.try_element_at(literal_map(values), key), default)
