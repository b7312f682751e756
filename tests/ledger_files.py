"""Ledger files used as fixtures."""

# The filled ledger of one client.
FILLED = """\
Cuenta de Pérdidas y Ganancias;AÑO 2025;AÑO 2024
;;
1. Importe neto de la cifra de negocios;679861,1;540678,43
7050    PRESTACIONES DE SERVICIOS;679861,1;540678,43
4. Aprovisionamientos;-218704,63;-204781,5
6020    COMPRAS DE OTROS APROVISIONAMI;-7074,33;-6971,1
6070    TRABAJOS REALIZADOS POR OTRAS;-211630,3;-197810,4
7. Otros gastos de explotación;-293751,27;-243856,74
6210    ARRENDAMIENTOS Y CÁNONES;-12015,6;-11681
6220    REPARACIONES Y CONSERVACIÓN;-1607,66;-1500,41
6230    SERVICIOS PROFESIONALES INDEP.;-191528,26;-149681,47
6230    SERVICIOS ASESORIA CONTABLE;-5305;-5369,51
6250    PRIMAS DE SEGUROS;-842,47;-701,31
6260    SERVICIOS BANCARIOS Y SIMILARE;-620,22;-619,44
6270    PUBLICID., PROPAGANDA Y RR.PP.;-27010,69;-26104,78
6280    SUMINISTROS;-3258,94;-3179,41
6290    OTROS SERVICIOS;-51098,35;-44519,41
6310    OTROS TRIBUTOS;-464,08;-500
8. Amortización de inmovilizado;-27854,11;-23308,81
6816    DOT. AMORT. MOBILIARIO;-1503,89;-500
6817    DOT. AMORT. EQ. ELEC. E INF.;-2301,05;-2301,05
6818    DOT.AMORT. DE ELEM. TRANSP.;-20507,76;-20507,76
6818    DOT.AMORT. DE ELEM. TRANSP. 2;-3541,41;0
11. Deterioro y resultado por enajenación de inmo.;9431,22;0
7710    B PROCEDENTES INMOV. MATERIAL;9431,22;0
13. Otros resultados;0;0
6780    GASTOS EXCEPCIONALES;0;0
A) RESULTADO DE EXPLOTACIÓN;148982,31;68731,38
15. Gastos financieros;-3856,76;-1503,17
6620    INTERESES DE DEUDAS, EMPRESAS;-3856,76;-1503,17
 B) RESULTADO FINANCIERO;-3856,76;-1503,17
 C) RESULTADO ANTES DE IMPUESTOS;145125,55;67228,21
Impuesto sobre sociedades;-33378,88;-15462,49
 D) RESULTADO DEL EJERCICIO;111746,67;51765,72
"""

# The closing summary of that ledger, added up by hand from the lines above.
FILLED_SUMMARY = {
    "Ventas": (679861.10, 540678.43),
    "Gastos": (-293751.27, -243856.74),
    "Profesionales (6230)": (-196833.26, -155050.98),
    "Salarios": (0.0, 0.0),
    "Amortizaciones": (-27854.11, -23308.81),
    "Arrendamientos": (-12015.60, -11681.00),
    "Suministros": (-3258.94, -3179.41),
    "Gastos financieros": (-3856.76, -1503.17),
    "Impuesto": (-33378.88, -15462.49),
    "Resultado": (111746.67, 51765.72),
}

# An empty template: indented labels, no amounts.
EMPTY = "\n".join(
    [FILLED.splitlines()[0], ";;", *[f"      {line.split(';')[0].strip()};;" for line in FILLED.splitlines()[2:]]]
)


def write(folder, name: str, text: str, bom: bool = True) -> str:
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8-sig" if bom else "utf-8")
    return str(folder)
