"""Property registry and unit factors as small dimension tables; all have a fixed size."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession

# Domain, property, symbol, label, field (empty: the property), and which of unit and temperature keys exist.
PROPERTIES = (
    ("thermoelectric", "zt", "ZT", "热电优值", "zt_values", "t"),
    ("thermoelectric", "electrical_conductivity", "σ", "电导率", "", "ut"),
    ("thermoelectric", "electrical_resistivity", "ρ", "电阻率", "", "ut"),
    ("thermoelectric", "seebeck_coefficient", "S", "塞贝克系数", "", "ut"),
    ("thermoelectric", "power_factor", "PF", "功率因子", "", "ut"),
    ("thermoelectric", "thermal_conductivity", "κ", "热导率", "", "ut"),
    ("ferroelectric", "remanent_polarization", "P_r", "剩余极化", "", "ut"),
    ("ferroelectric", "saturation_polarization", "P_s", "饱和极化", "", "ut"),
    ("ferroelectric", "coercive_field", "E_c", "矫顽场", "", "ut"),
    ("ferroelectric", "curie_temperature", "T_C", "居里温度", "", "u"),
    ("ferroelectric", "dielectric_permittivity", "ε_r", "相对介电常数", "", "t"),
    ("piezoelectric", "piezoelectric_coefficient_d33", "d_33", "压电常数d33", "", "ut"),
    ("piezoelectric", "piezoelectric_coefficient_d31", "d_31", "压电常数d31", "", "ut"),
    ("piezoelectric", "electromechanical_coupling_kp", "k_p", "平面机电耦合系数", "", "t"),
    ("piezoelectric", "electromechanical_coupling_k33", "k_33", "纵向机电耦合系数", "", "t"),
    ("piezoelectric", "mechanical_quality_factor", "Q_m", "机械品质因数", "", "t"),
    ("piezoelectric", "curie_temperature", "T_C", "居里温度", "", "u"),
    ("piezoelectric", "dielectric_permittivity", "ε_r", "相对介电常数", "", "t"),
    ("phasechange", "crystallization_temperature", "T_x", "结晶温度", "", "u"),
    ("phasechange", "melting_temperature", "T_m", "熔点", "", "u"),
    ("phasechange", "amorphous_resistivity", "ρ_amor", "非晶态电阻率", "", "ut"),
    ("phasechange", "crystalline_resistivity", "ρ_cry", "晶态电阻率", "", "ut"),
    ("phasechange", "resistivity_contrast", "R_ratio", "电阻率对比度", "", ""),
    ("phasechange", "thermal_conductivity", "κ", "热导率", "", "ut"),
    ("phasechange", "threshold_switching_voltage", "V_th", "阈值开关电压", "", "ut"),
    ("phasechange", "data_retention_temperature", "T_retention", "数据保持温度", "", "u"),
    ("phasechange", "switching_speed", "t_sw", "置/复位时间", "", "u"),
    ("phasechange", "endurance_cycles", "endurance", "循环寿命", "", "u"),
)

# Domain, property, target unit, and factors of the units that convert to it. Keys that are not in lower case never match a lower-cased unit.
UNITS = (
    ("thermoelectric", "seebeck_coefficient", "μV/K", {"μV/K": 1, "uv/k": 1, "µV/K": 1, "V/K": 1e6, "v/k": 1e6}),
    ("thermoelectric", "electrical_conductivity", "S/m", {"S/m": 1, "s/m": 1, "S/cm": 100, "s/cm": 100}),
    ("thermoelectric", "electrical_resistivity", "Ω·m", {"Ω·m": 1, "ohm·m": 1, "Ω·cm": 0.01, "ohm·cm": 0.01}),
    ("thermoelectric", "power_factor", "μW/m·K²", {"μW/m·K²": 1, "uw/m·k2": 1}),
    ("thermoelectric", "thermal_conductivity", "W/m·K", {"W/m·K": 1, "w/m·k": 1}),
    ("ferroelectric", "remanent_polarization", "μC/cm²", {"μC/cm²": 1, "uc/cm2": 1}),
    ("ferroelectric", "saturation_polarization", "μC/cm²", {"μC/cm²": 1, "uc/cm2": 1}),
    ("ferroelectric", "coercive_field", "kV/cm", {"kV/cm": 1, "kv/cm": 1}),
    ("piezoelectric", "piezoelectric_coefficient_d33", "pC/N", {"pC/N": 1, "pc/n": 1, "C/N": 1e12}),
    ("piezoelectric", "piezoelectric_coefficient_d31", "pC/N", {"pC/N": 1, "pc/n": 1, "C/N": 1e12}),
    ("phasechange", "crystallization_temperature", "°C", {"°C": 1, "c": 1, "℃": 1}),
    ("phasechange", "melting_temperature", "°C", {"°C": 1, "c": 1, "℃": 1}),
    ("phasechange", "data_retention_temperature", "°C", {"°C": 1, "c": 1, "℃": 1}),
    ("phasechange", "amorphous_resistivity", "Ω·cm", {"Ω·cm": 1, "ohm·cm": 1, "Ω·m": 100}),
    ("phasechange", "crystalline_resistivity", "Ω·cm", {"Ω·cm": 1, "ohm·cm": 1, "Ω·m": 100}),
    ("phasechange", "thermal_conductivity", "W/m·K", {"W/m·K": 1, "w/m·k": 1}),
    ("phasechange", "threshold_switching_voltage", "V", {"V": 1, "v": 1, "mV": 0.001}),
    ("phasechange", "switching_speed", "ns", {"ns": 1, "nsec": 1, "µs": 1000, "μs": 1000}),
    ("phasechange", "endurance_cycles", "次", {"cycles": 1, "次": 1}),
)


@dataclass(frozen=True)
class Spec:
    """One property: where its numbers, units and temperatures stand in nested records, and what unit they are brought to."""

    domain: str
    property_id: str
    symbol: str
    label: str
    field: str
    numeric_key: str | None
    unit_key: str | None
    temperature_key: str | None
    temperature_unit_key: str | None
    target_unit: str = ""

    @property
    def key(self) -> str:
        return f"{self.domain}:{self.property_id}"

    @property
    def unit_known(self) -> bool:
        return bool(self.target_unit)


def specs(domains: tuple[str, ...] | None = None) -> list[Spec]:
    """Specs of the given domains, all by default. Keys are the symbol with a suffix; the figure of merit alone has its own."""
    targets = {(d, p): t for d, p, t, _ in UNITS}
    out = []
    for domain, prop, symbol, label, field, has in PROPERTIES:
        spec = Spec(
            domain, prop, symbol, label, field or prop, f"{symbol}_value", f"{symbol}_unit" if "u" in has else None,
            f"{symbol}_Temperature" if "t" in has else None, f"{symbol}_Temp_unit" if "t" in has else None, targets.get((domain, prop), ""),
        )
        if prop == "zt":
            spec = replace(spec, numeric_key="value", temperature_key="ZT_temperature", temperature_unit_key="ZT_temperature_unit")
        if domains is None or domain in domains:
            out.append(spec)
    return out


def header_registry(domains: tuple[str, ...] | None = None) -> list[Spec]:
    """Specs for headers: of equal property and symbol the first domain's."""
    first: dict[tuple[str, str], Spec] = {}
    for s in specs(domains):
        first.setdefault((s.property_id, s.symbol), s)
    return list(first.values())


def unit_factors(strict: bool = False) -> dict[tuple[str, str], float]:
    """(property key, lower-cased unit) -> factor. By default only keys already in lower case match; ``strict`` lower-cases all."""
    return {(f"{d}:{p}", k.lower() if strict else k): float(f) for d, p, _, fs in UNITS for k, f in fs.items() if strict or k == k.lower()}


def factor_table(spark: SparkSession, strict: bool = False) -> DataFrame:
    return spark.createDataFrame([(k, u, f) for (k, u), f in unit_factors(strict).items()], "property_key string, unit_lower string, factor double")


def spec_table(spark: SparkSession, domains: tuple[str, ...] | None = None) -> DataFrame:
    rows = [(s.key, s.domain, s.property_id, s.symbol, s.label, s.field, s.numeric_key, s.unit_key, s.temperature_key, s.temperature_unit_key, s.target_unit, s.unit_known) for s in specs(domains)]
    return spark.createDataFrame(rows, "property_key string, domain string, property_id string, symbol string, label string, field string, numeric_key string, unit_key string, temperature_key string, temperature_unit_key string, target_unit string, unit_known boolean")


#: Context fields that an extracted value may carry along.
CONTEXT_FIELDS = (
    "sample_form", "phase_state", "measurement_method", "heating_rate", "film_thickness", "pulse_type", "pulse_width", "evidence_quote",
    "evidence_section", "evidence_page", "evidence_table", "evidence_table_row", "evidence_table_column", "crystallization_definition", "value_origin", "endurance_basis",
)


def validate_domain(domain: dict) -> list[str]:
    """Errors of a user's property domain: label, material keywords and, per property, symbol, label and field must be there."""
    errors = [f"missing {k}" for k in ("label", "material_keywords", "properties") if not domain.get(k)]
    for name, prop in (domain.get("properties") or {}).items():
        errors += [f"property {name}: missing {k}" for k in ("symbol", "label", "field") if not prop.get(k)]
    return errors


def normalize_domain(name: str | None, default: str = "thermoelectric") -> str:
    known = {s.domain for s in specs()}
    name = (name or "").strip().lower()
    return name if name in known else default
