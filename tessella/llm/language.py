"""Languages by their function words; the words are closed classes, so the lists don't grow with the corpus."""

from __future__ import annotations

import re

FUNCTION_WORDS: dict[str, frozenset[str]] = {
    "en": frozenset(
        "a an the this that these those each every some any no another few many most several all both either one two three four five six ten "
        "i you he she it we they me him us them my your his her its our their who whom which what whose where when why how "
        "and or but yet so nor if unless until while because since although though whenever as than then "
        "of in on at by for from with without to into onto over under through across against before after beside beyond inside near between during upon about "
        "is are was were be been being has have had do does did can cannot could may might must shall should will would not there here".split()
    ),
    "es": frozenset(
        "el la los las un una unos unas lo al del de a en con por para sin sobre entre desde hasta hacia bajo contra tras durante según detrás antes después medio "
        "y e o u pero aunque porque ya que si como cuando donde cómo qué quién cuál cuándo dónde sino pues mientras "
        "yo tú él ella nosotros ellos ellas me te se le les nos su sus mi mis tu tus este esta estos estas ese esa eso esto aquel "
        "no ni más menos muy también todo toda todos todas otro otra cada solo "
        "es son era fue ser está están hay ha han había puede pueden debe tiene hace".split()
    ),
    "fr": frozenset(
        "le la les un une des du de d l à au aux en dans sur sous avec sans pour par entre depuis pendant durant contre vers chez derrière avant après malgré "
        "et ou mais donc car ni or que qu si comme quand où comment pourquoi puisque pourtant lorsque quoi "
        "je tu il elle nous vous ils elles me te se s n lui leur y mon ma mes ton ta son sa ses notre votre leurs ce cet cette ces qui dont "
        "ne pas plus moins très aussi tout toute tous toutes seulement autre chaque "
        "est sont était fut être a ont avait peut peuvent doit fait".split()
    ),
    "de": frozenset(
        "der die das den dem des ein eine einen einem einer eines kein keine keinen keinem "
        "und oder aber denn doch sondern weil wenn dass ob als wie wo wann warum was wer während seit bevor nachdem "
        "ich du er sie es wir ihr mich dich sich uns euch mir dir ihm ihnen mein dein sein seine ihre unser dieser diese dieses jeder jede man "
        "in im an am auf aus bei beim mit nach von vom vor zu zum zur über unter für gegen ohne um durch hinter zwischen trotz wegen bis "
        "nicht nur noch auch sehr schon mehr so hier dort "
        "ist sind war waren sein hat haben hatte wird werden kann können muss müssen darf dürfen soll will".split()
    ),
    "it": frozenset(
        "il lo gli i uno dei degli delle della dello nel nella nei sul sulla dal dalla alla allo ai agli di da con per tra fra "
        "e ed ma però perché quando dove come chi che cui anche non più meno molto sono è era essere ha hanno può deve questo questa quello quella suo sua".split()
    ),
    "pt": frozenset(
        "o os um uma uns umas do da dos das no na nos nas ao aos à às pelo pela com para por sem sobre entre até desde "
        "e ou mas porém porque quando onde como quem que não mais menos muito também são é era foi ser tem têm pode deve este esta esse essa seu sua".split()
    ),
    "nl": frozenset(
        "de het een en of maar want omdat als dat die wie wat waar wanneer hoe waarom niet geen ook nog wel zeer meer "
        "ik jij hij zij wij jullie mij hem haar ons hun mijn zijn van in op aan bij met naar door voor tegen zonder over onder tussen tijdens "
        "is was waren zijn heeft hebben had kan moet mag zal worden wordt".split()
    ),
}
ALL_FUNCTION_WORDS = frozenset().union(*FUNCTION_WORDS.values())
#: Words of shops and offers.
COMMERCE = frozenset(
    "buy cheap cheapest order sale sales discount discounts deal deals coupon coupons wholesale bulk shipping price prices best top offer offers shop store online free review reviews sku checkout bargain clearance promo near me new now "
    "comprar compra barato barata baratos precio precios oferta ofertas descuento descuentos envío gratis tienda línea mejor mejores rebajas pedido venta "
    "acheter achat boutique prix cher chère ligne solde soldes promo livraison meilleur meilleure gratuit gratuite offre offres remise commander vente "
    "kaufen preis preise günstig billig rabatt versand bestellen angebot angebote kostenlos beste bester laden gutschein verkauf online "
    "comprare prezzo prezzi sconto offerta spedizione negozio economico preço desconto loja frete grátis kopen goedkoop prijs korting bestel winkel aanbieding".split()
)
#: A word that several languages share counts in part for each of them.
WEIGHTS: dict[str, dict[str, float]] = {}
for _lang, _words in FUNCTION_WORDS.items():
    for _w in _words:
        WEIGHTS.setdefault(_w, {})[_lang] = 1.0 / sum(_w in v for v in FUNCTION_WORDS.values())

_LETTERS = re.compile(r"[^\W\d_]+")


def letters_words(text: str) -> list[str]:
    return _LETTERS.findall(text.lower())


def language_scores(words: list[str]) -> dict[str, float]:
    """Weighted function words met, by language."""
    got: dict[str, float] = {}
    for w in words:
        by = WEIGHTS.get(w)
        if by:
            for lang, weight in by.items():
                got[lang] = got.get(lang, 0.0) + weight
    return got


def detect(words: list[str], least: float = 1.0, margin: float = 1.5) -> str | None:
    """The language whose function words lead by `margin` times; None where too few tell."""
    got = language_scores(words)
    if not got:
        return None
    best = max(got, key=lambda x: (got[x], x))
    rest = max((v for k, v in got.items() if k != best), default=0.0)
    return best if got[best] >= least and got[best] >= margin * rest else None
