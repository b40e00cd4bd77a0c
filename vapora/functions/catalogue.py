"""Compounds, mixtures, classes and percepts as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Id | name | synonyms | molecular weight | boiling point in C | vapour pressure at 25 C in Pa | Antoine a b c |
#: functional groups | flags (gas, redox, inert) | odour | CAS | SMILES. A ~ marks an estimate, a ? an unknown.
COMPOUNDS = """
ethanol|Ethanol|ethyl alcohol; alcohol; grain alcohol; drinking alcohol|46.07|78.37|7870|8.20417 1642.89 230.3|alcohol|redox|alcoholic, solvent|64-17-5|CCO
methanol|Methanol|methyl alcohol; wood alcohol|32.04|64.7|16900|8.08097 1582.271 239.726|alcohol|redox|alcoholic, pungent|67-56-1|CO
isopropanol|Isopropanol|isopropyl alcohol; rubbing alcohol; propan-2-ol; IPA|60.1|82.6|6020|8.87829 2010.33 252.636|alcohol|redox|alcoholic, sweet|67-63-0|CC(C)O
acetone|Acetone|propanone; dimethyl ketone; nail polish remover|58.08|56.05|30600|7.11714 1210.595 229.664|ketone|redox|sweet, fruity, solvent|67-64-1|CC(=O)C
acetaldehyde|Acetaldehyde|ethanal; acetaldehyde (in foods)|44.05|20.2|120000||aldehyde|redox|pungent, fruity|75-07-0|CC=O
acetic-acid|Acetic acid|ethanoic acid; vinegar; glacial acetic acid|60.05|118|2090||carboxylic acid|redox|vinegar, sour|64-19-7|CC(=O)O
butyric-acid|Butyric acid|butanoic acid; n-butyric acid|88.11|163.5|~110||carboxylic acid|redox|rancid butter, vomit|107-92-6|CCCC(=O)O
benzene|Benzene|benzin|78.11|80.1|12700|6.90565 1211.033 220.79|aromatic|redox|aromatic, solvent|71-43-2|c1ccccc1
toluene|Toluene|methylbenzene; toluol|92.14|110.6|3790|6.95464 1344.8 219.48|aromatic|redox|aromatic, paint-like|108-88-3|Cc1ccccc1
xylene|Xylene|dimethylbenzene; m-xylene; xylol|106.17|139|~1100||aromatic|redox|sweet, solvent|108-38-3|Cc1cccc(C)c1
hexane|n-Hexane|hexane; normal hexane|86.18|68.7|20000||alkane|redox|gasoline-like, faint|110-54-3|CCCCCC
isopentane|Isopentane|2-methylbutane|72.15|27.8|~95000||alkane|redox|gasoline-like|78-78-4|CCC(C)C
isoamyl-acetate|Isoamyl acetate|isopentyl acetate; 3-methylbutyl acetate; banana oil|130.18|142|~700||ester|redox|banana, pear|123-92-2|CC(C)CCOC(C)=O
ethyl-acetate|Ethyl acetate|acetic ester; ethyl ethanoate|88.11|77.1|12600||ester|redox|sweet, fruity, solvent|141-78-6|CCOC(C)=O
butyl-acetate|Butyl acetate|n-butyl acetate; butyl ethanoate|116.16|126|~1330||ester|redox|sweet, fruity, banana|123-86-4|CCCCOC(C)=O
isoamyl-butyrate|Isoamyl butyrate|isopentyl butyrate; 3-methylbutyl butanoate|158.24|~179|~60||ester|redox|fruity, apricot|106-27-4|CCCC(=O)OCCC(C)C
isoamyl-isovalerate|Isoamyl isovalerate|isopentyl 3-methylbutanoate; isopentyl isovalerate|172.26|~193|~40||ester|redox|apple, fruity|659-70-1|CC(C)CC(=O)OCCC(C)C
methyl-butyrate|Methyl butyrate|methyl butanoate|102.13|102.8|~3000||ester|redox|apple, pineapple|623-42-7|CCCC(=O)OC
ethyl-butyrate|Ethyl butyrate|ethyl butanoate|116.16|121.5|~2000||ester|redox|fruity, pineapple|105-54-4|CCCC(=O)OCC
hexanal|Hexanal|n-hexanal; caproaldehyde; hexyl aldehyde|100.16|131|~1330||aldehyde|redox|grassy, green, tallow|66-25-1|CCCCCC=O
e2-hexenal|(E)-2-Hexenal|trans-2-hexenal; leaf aldehyde; hex-2-enal|98.14|147|~600||aldehyde; alkene|redox|green leaf, apple|6728-26-3|CCCC=CC=O
hexanol|1-Hexanol|n-hexanol; hexan-1-ol|102.17|157|~133||alcohol|redox|green, grassy, fruity|111-27-3|CCCCCCO
eugenol|Eugenol|clove oil; 4-allyl-2-methoxyphenol|164.2|254|~2.7||phenol; ether; alkene|redox|clove, spicy|97-53-0|COc1cc(CC=C)ccc1O
cinnamaldehyde|Cinnamaldehyde|cinnamic aldehyde; 3-phenylpropenal; cinnamon aldehyde|132.16|248|~1.3||aldehyde; alkene; aromatic|redox|cinnamon, spicy|104-55-2|O=C/C=C/c1ccccc1
linalool|Linalool|linalol; coriandrol|154.25|198|~26||alcohol; terpene; alkene|redox|floral, lavender, citrus|78-70-6|CC(C)=CCCC(C)(O)C=C
limonene|Limonene|d-limonene; citrus terpene|136.23|176|~270||terpene; alkene|redox|citrus, orange|5989-27-5|CC1=CCC(CC1)C(C)=C
alpha-pinene|alpha-Pinene|alpha-pinene; pinene|136.23|155|~627||terpene; alkene|redox|pine, resinous|80-56-8|CC1=CCC2CC1C2(C)C
myrcene|beta-Myrcene|myrcene; beta-myrcene|136.23|~167|~300||terpene; alkene|redox|resinous, balsamic|123-35-3|CC(=C)CCC=C(C)C
menthol|Menthol|l-menthol; peppermint camphor|156.27|212|~7||alcohol; terpene|redox|mint, cooling|2216-51-5|CC1CCC(C(C1)O)C(C)C
menthone|Menthone|l-menthone; peppermint ketone|154.25|~207|~26||ketone; terpene|redox|mint, peppermint|10458-14-7|CC1CCC(C(=O)C1)C(C)C
guaiacol|Guaiacol|2-methoxyphenol; o-methoxyphenol|124.14|205|~20||phenol; ether|redox|smoky, medicinal|90-05-1|COc1ccccc1O
phenol|Phenol|carbolic acid; hydroxybenzene|94.11|181.8|~47||phenol; aromatic|redox|phenolic, tar-like|108-95-2|Oc1ccccc1
furfural|Furfural|furfuraldehyde; 2-furaldehyde|96.08|161.7|~260||aldehyde; furan; aromatic|redox|almond, bready, caramel|98-01-1|O=Cc1ccco1
diacetyl|2,3-Butanedione|diacetyl; dimethyl diketone|86.09|88|~7000||ketone; diketone|redox|buttery, creamy|431-03-8|CC(=O)C(C)=O
diallyl-disulfide|Diallyl disulfide|garlic oil; 4,5-dithia-1,7-octadiene|146.27|~177|~130||thioether; sulfur; alkene|redox|garlic, pungent|2179-57-9|C=CCSSCC=C
ammonia|Ammonia|NH3; ammonium gas|17.03|-33.3|?||amine|gas redox|pungent, sharp|7664-41-7|N
methane|Methane|natural gas; CH4|16.04|-161.5|?||alkane|gas redox|odorless (odorized in supply)|74-82-8|C
propane|Propane|LPG; liquefied petroleum gas|44.1|-42.1|?||alkane|gas redox|odorless (odorized)|74-98-6|CCC
butane|n-Butane|butane; liquefied gas|58.12|-0.5|~240000||alkane|gas redox|odorless (odorized)|106-97-8|CCCC
hydrogen-sulfide|Hydrogen sulfide|H2S; sulfane; sewer gas|34.08|-60.3|?||thiol; sulfur|gas redox|rotten eggs|7783-06-4|S
methanethiol|Methanethiol|methyl mercaptan; mercaptomethane|48.11|5.95|?||thiol; sulfur|gas redox|rotten cabbage, sulfurous|74-93-1|CS
dimethyl-sulfide|Dimethyl sulfide|DMS; methylthiomethane|62.13|37.3|~64000||thioether; sulfur|redox|seafood, cabbage, sulfurous|75-18-3|CSC
ethylene|Ethylene|ethene; fruit ripening gas|28.05|-103.7|?||alkene|gas redox|sweet, ethereal|74-85-1|C=C
carbon-monoxide|Carbon monoxide|CO; exhaust gas|28.01|-191.5|?||inorganic|gas redox|odorless|630-08-0|[C-]#[O+]
carbon-dioxide|Carbon dioxide|CO2; carbonic anhydride|44.01|-78.5|?||inorganic|gas inert|odorless|124-38-9|O=C=O
nitrogen|Nitrogen|N2; dinitrogen|28.01|-195.8|?||inorganic|gas inert|odorless|7727-37-9|N#N
oxygen|Oxygen|O2; dioxygen|32.0|-183|?||inorganic|gas|odorless|7782-44-7|O=O
water|Water|H2O; water vapor; humidity|18.02|100|3170||inorganic||odorless (humidity response)|7732-18-5|O
"""

#: Id | name | kind | synonyms | constituents by estimated weight.
COMPOSITES = """
banana|Banana|food|ripe banana; banana fruit; banana aroma|isoamyl-acetate 0.5, isoamyl-butyrate 0.15, butyl-acetate 0.1, isoamyl-isovalerate 0.1, hexanal 0.05, e2-hexenal 0.05, hexanol 0.05
cinnamon|Cinnamon|spice|cinnamon bark; cinnamon powder; ceylon cinnamon|cinnamaldehyde 0.65, eugenol 0.2, linalool 0.05, limonene 0.05
coffee|Coffee|beverage|roasted coffee; coffee beans; espresso|diacetyl 0.25, furfural 0.2, acetaldehyde 0.15, acetic-acid 0.15, guaiacol 0.1
garlic|Garlic|food|raw garlic; garlic clove; garlic powder|diallyl-disulfide 0.6, methanethiol 0.15, dimethyl-sulfide 0.1
peppermint|Peppermint|spice|mint; spearmint; peppermint oil|menthol 0.55, menthone 0.3, limonene 0.15
lemon|Lemon|food|lemon peel; lemon zest; citrus lemon|limonene 0.6, linalool 0.15, alpha-pinene 0.1, myrcene 0.05
orange|Orange|food|orange peel; sweet orange|limonene 0.7, linalool 0.1, alpha-pinene 0.05
strawberry|Strawberry|food|ripe strawberry; strawberry aroma|methyl-butyrate 0.35, ethyl-butyrate 0.3, isoamyl-acetate 0.15, hexanal 0.1
apple|Apple|food|fresh apple; apple aroma; granny smith|hexanal 0.3, e2-hexenal 0.25, butyl-acetate 0.2, ethyl-butyrate 0.1
tomato|Tomato|food|fresh tomato; tomato leaf; ripe tomato|hexanal 0.4, e2-hexenal 0.3, hexanol 0.15, limonene 0.05
vinegar|Vinegar|food|white vinegar; apple cider vinegar; acetic acid vinegar|acetic-acid 0.85, acetaldehyde 0.05
wine|Wine|beverage|red wine; white wine; grape wine|ethanol 0.7, ethyl-acetate 0.15, ethyl-butyrate 0.05, acetic-acid 0.05
beer|Beer|beverage|lager; ale; draft beer|ethanol 0.55, myrcene 0.1, linalool 0.1, diacetyl 0.05, acetic-acid 0.05
bread|Bread|food|fresh bread; baked bread; bread crust|diacetyl 0.3, furfural 0.2, acetaldehyde 0.15, ethanol 0.1
spoiled-milk|Spoiled milk|food|sour milk; off milk; spoiled dairy|butyric-acid 0.45, dimethyl-sulfide 0.2, hydrogen-sulfide 0.15, acetaldehyde 0.1
gasoline|Gasoline|material|petrol; fuel; unleaded gasoline|toluene 0.35, xylene 0.25, hexane 0.15, benzene 0.1, isopentane 0.1
wood-smoke|Wood smoke|activity|smoke; fire smoke; campfire; burning wood|guaiacol 0.35, phenol 0.25, eugenol 0.1, acetaldehyde 0.1, furfural 0.05
paint-thinner|Paint thinner|product|mineral spirits; white spirit; solvent|toluene 0.4, xylene 0.3, ethyl-acetate 0.15, acetone 0.1
nail-polish-remover|Nail polish remover|product|acetone remover; polish remover|acetone 0.9
hand-sanitizer|Hand sanitizer|product|sanitizer gel; hand rub; alcohol gel|ethanol 0.7, isopropanol 0.2
natural-gas|Natural gas|activity|gas leak; methane leak; utility gas|methane 0.9, methanethiol 0.05, butane 0.05
propane-leak|Propane / LPG|activity|propane tank; grill gas; LPG leak|propane 0.95, methanethiol 0.05
sewer|Sewer odor|activity|drain smell; septic; wastewater|hydrogen-sulfide 0.45, ammonia 0.25, methanethiol 0.15, dimethyl-sulfide 0.1
rotten-egg|Rotten egg|food|sulfurous egg; bad egg|hydrogen-sulfide 0.95
car-exhaust|Car exhaust|activity|vehicle exhaust; tailpipe; engine emissions|carbon-monoxide 0.8, acetaldehyde 0.05, benzene 0.05
ripe-fruit-gas|Ripe fruit (ethylene)|activity|ethylene ripening; fruit ripening; climacteric fruit gas|ethylene 0.9
"""

#: Class | label | functional groups.
CLASSES = """
alcohol|Alcohols|alcohol
aldehyde|Aldehydes|aldehyde
ketone|Ketones|ketone
ester|Esters|ester
carboxylic acid|Carboxylic acids|carboxylic acid
alkane|Alkanes|alkane
alkene|Alkenes|alkene
terpene|Terpenes|terpene
thiol|Thiols / mercaptans|thiol
sulfide|Organic sulfides|thioether; sulfur
amine|Amines|amine
phenol|Phenols|phenol
aromatic|Aromatic hydrocarbons|aromatic
ether|Ethers|ether
"""

#: Percept | label | functional groups | keywords of names and odours.
PERCEPTS = """
fruity-ester|Fruity / sweet esters|ester|fruity; banana; pineapple; sweet; apricot; apple; pear
citrus-terpenic|Citrus / terpenic|terpene|citrus; terpene; lemon; pine; orange
green-leafy|Green / leafy||green; grassy; leaf; leafy; tallow
floral|Floral||floral; lavender; rose; violet
minty|Minty / cooling||mint; menthol; cooling
spicy-balsamic|Spicy / balsamic|phenol|cinnamon; spicy; clove
roasted-caramel|Roasted / caramel||roast; caramel; bakey; butter; toasted
smoky-phenolic|Smoky / phenolic|phenol|smoke; smoky; phenolic; campfire; creosote
sulfurous|Sulfurous / rotten|thiol; thioether; sulfur|sulfurous; garlic; sewer; rotten; skunk; gas
ammoniacal|Ammoniacal|amine|ammonia; fishy; urine
solvent-industrial|Solvent / industrial||solvent; gasoline; paint; fuel; aromatic
alcoholic|Alcoholic|alcohol|alcohol; alcoholic
sour-acidic|Sour / acidic|carboxylic acid|vinegar; sour; rancid; acidic
neutral-gas|Odorless combustibles||methane; propane; odorless
"""
#: Percepts of low volatility.
LOW_VOLATILITY = ("spicy-balsamic", "smoky-phenolic")

#: Technology | mechanism's observables | latent state | environment.
TECHNOLOGIES = """
mox|resistance; conductance|O- coverage; band bending psi_s; depletion width W; surface electron density n_s|temperature; humidity; flow; pO2
mems_chemiresistor|resistance; temperature-modulated resistance; impedance|film coverage; temperature setpoint; modulation phase state|temperature; humidity
electrochemical|current; voltage; charge|analyte flux; electrode potential; diffusion layer; reaction product accumulation|temperature; pressure; humidity
capacitive|capacitance; dielectric loss|film permittivity; swelling ratio; absorbed mass|temperature; humidity
photoionization|ion current|ion flux; ionisation potential response|temperature; humidity
optical_ir|absorbance spectrum; photocurrent|absorber column density per band; path length|temperature; pressure
gravimetric|resonant frequency; phase|adsorbed mass; viscoelastic loading|temperature; humidity
"""


def _lines(text: str) -> list[list[str]]:
    return [line.split("|") for line in text.strip().splitlines()]


def _list(cell: str) -> list[str]:
    return [x for x in cell.split("; ") if x]


def _property(cell: str) -> tuple[float | None, str]:
    if cell == "?":
        return None, "unknown"
    return (float(cell[1:]), "estimated") if cell[0] == "~" else (float(cell), "measured")


_P = "struct<value:double,source:string>"
COMPOUND_SCHEMA = (
    f"ord int, id string, name string, synonyms array<string>, molecular_weight {_P}, boiling_point {_P}, vapor_pressure {_P}, antoine struct<a:double,b:double,c:double>, "
    "groups array<string>, gas boolean, redox_active boolean, non_redox boolean, odor string, cas string, smiles string, provisional boolean"
)


def compound_rows() -> list[tuple]:
    out = []
    for k, (i, name, syn, mw, bp, vp, ant, groups, flags, odor, cas, smiles) in enumerate(_lines(COMPOUNDS)):
        abc = tuple(map(float, ant.split())) if ant else None
        out.append((k, i, name, _list(syn), _property(mw), _property(bp), _property(vp), abc, _list(groups), "gas" in flags, "redox" in flags, "inert" in flags, odor, cas, smiles, False))
    return out


def compounds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(compound_rows(), COMPOUND_SCHEMA)


def composite_rows() -> list[tuple]:
    return [(k, i, name, kind, _list(syn), [(c, float(w), "estimated") for c, w in (x.split() for x in parts.split(", "))]) for k, (i, name, kind, syn, parts) in enumerate(_lines(COMPOSITES))]


def composites(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(composite_rows(), "ord int, id string, name string, kind string, synonyms array<string>, constituents array<struct<chemical_id:string,weight:double,source:string>>")


def class_rows() -> list[tuple]:
    return [(k, key, label, _list(groups)) for k, (key, label, groups) in enumerate(_lines(CLASSES))]


def classes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(class_rows(), "ord int, class string, label string, groups array<string>")


def percept_rows() -> list[tuple]:
    return [(k, i, label, _list(groups), _list(words)) for k, (i, label, groups, words) in enumerate(_lines(PERCEPTS))]


def percepts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(percept_rows(), "ord int, percept string, label string, groups array<string>, keywords array<string>")


def technologies(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t, _list(o), _list(s), _list(e)) for t, o, s, e in _lines(TECHNOLOGIES)], "technology string, observables array<string>, latent_state array<string>, environment array<string>")
