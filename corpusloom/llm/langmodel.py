"""Likelihood of a stretch of text under nine languages and a class for all others.

Features are runs of three characters and single characters (by block of 64 beyond the alphabets), hashed into tables
of fixed size. Counts come from labelled rows and, as pseudo-counts, from short lists of function words, which keep
a language known that no row is labelled with. A language's probabilities lean on those of all languages together, so
one with few counts is never favoured by rare strings. The class of all others is those of all languages together with a
large uniform part: it wins for a language that none of the nine explains.
"""

from __future__ import annotations

import math
from functools import cache

import numpy as np

from . import bulk

LANGS = ("en", "de", "fr", "es", "pt", "it", "nl", "ru", "zh")

#: Frequent function words.
FUNCTION_WORDS = {
    "en": "the of and a an to in that is was were for it its by at on with as than over into which not from when if no this these are be been has have had but or they their while after before between under more most every each other one two so because although neither nor we our he she his her only how why what there then them can would could will did does despite once",
    "de": "der die das den dem des und in von zu zur zum mit ist nicht ein eine einen einem einer eines im für auf sich bei nach vor über unter durch gegen ohne aus als wie auch noch nur so sowie wenn weil da dass obwohl bevor während war waren wird werden wurde hat haben hatte sind es sie er wir ihre seine kein keine dieser diese dieses um am vom oder aber künftig mehr zwischen trotz",
    "fr": "le la les l de d des du et en un une au aux que qu qui dans sur est sont par pour pas ne se son sa ses ce cette ces avec sans sous entre plus ou où mais si il elle ils nous vous leur leurs été a ont avait afin ainsi comme chez même après avant car bien lorsque pendant malgré depuis puisque quand tout toute tous très bientôt",
    "es": "el la los las de del y e en un una unos unas que se con por para no es son al lo su sus como más pero o u si sin sobre entre ya fue era ha han había este esta estos estas ese esa hasta desde porque cuando antes después durante aunque mientras además muy todo toda todos cada según siempre pues ni le les nos pronto bajo",
    "pt": "o a os as de do da dos das e em no na nos nas um uma uns umas que se com por para pelo pela não é são ao à aos às sua seu suas seus como mais mas ou sem sobre entre já foi era tem têm havia este esta isto esse essa até desde porque quando antes depois durante embora enquanto bem muito todo toda cada pois nem lhe nós pouco breve",
    "it": "il lo la i gli le di del dello della dei degli delle e ed in nel nella nei nelle un uno una che si con per non è sono al allo alla ai alle da dal dalla su sul sulla come più ma o se senza fra tra già era ha hanno questo questa questi quello fino perché quando prima dopo durante benché mentre anche molto tutto ogni poiché né gli loro presto",
    "nl": "de het een en van in op te dat die is was niet met voor aan er om door over uit bij naar als dan ook maar of nog wel geen zijn haar hun ze hij wij wordt worden werd heeft hebben had deze dit want omdat hoewel voordat terwijl tijdens zonder onder tussen tegen na tot zo meer elke alle waar wat wie binnenkort volgens",
    "ru": "и в во на не что с со по за из от до для о об к ко как а но или же бы это то этот эта эти его её их он она они мы вы который которая которые если когда прежде чем хотя потому так также при без под над между после через был была были есть нет уже ещё только все всё каждой том",
    "zh": "",
}
#: Frequent Chinese characters.
ZH_CHARS = frozenset("的一是了在和有不这中人为以及到个上地我们国要用时而于家可对就也与之其")


_OF: dict[str, list[tuple[int, float]]] = {}
for _k, _lang in enumerate(LANGS):
    for _w in FUNCTION_WORDS[_lang].split():
        _OF.setdefault(_w, []).append((_k, 0.0))
_OF = {w: [(k, 2.2 - 0.9 * math.log(len(ks)) if len(ks) > 1 else 2.2) for k, _ in ks] for w, ks in _OF.items()}
#: Word -> weight by language, in the order of LANGS.
WEIGHTS = {w: [dict(ks).get(k, 0.0) for k in range(len(LANGS))] for w, ks in _OF.items()}
#: Classes: the languages and all others.
CLASSES = (*LANGS, "und")
#: Table sizes of runs of three characters and of single ones.
RUNS, SINGLES = 1 << 15, 1 << 12
#: Times that a function word counts; weight of all languages together in one, as a count and as a share of its own
#: counts; uniform parts in a language and in "und".
SEED, LEAN, LEAN_SHARE, UNIFORM, OTHER_UNIFORM = 60, 3000.0, 0.1, 0.3, 0.4
#: Neighbouring runs overlap, so their evidence is not independent: nats count by this.
TEMPER = 0.3

_P = tuple(np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D))


def features(t: bulk.Text) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, run bucket, single bucket) of the places at a letter (or lost character) of lower-case texts."""
    letter = (t.kind == bulk.ALNUM) & ~((t.codes >= 48) & (t.codes <= 57)) | (t.codes == 0xFFFD)
    c = np.where(letter, t.codes, np.uint32(32))
    c = np.where(c < 0x600, c, 0x600 + (c >> 6)).astype(np.uint32)  # beyond the alphabets, blocks of 64
    at = np.flatnonzero(letter)
    pad = np.concatenate([[np.uint32(32)], c, [np.uint32(32)]]).astype(np.uint32)
    run = pad[at] * _P[0] + pad[at + 1] * _P[1] + pad[at + 2] * _P[2]
    run ^= run >> np.uint32(15)
    run = (run * _P[0]) >> np.uint32(17)
    single = c[at] & np.uint32(SINGLES - 1)
    return at, run.astype(np.int64), single.astype(np.int64)


def lowered(texts: list[str | None]) -> bulk.Text:
    return bulk.text([t.lower() if t else "" for t in texts])


@cache
def seeds() -> tuple[np.ndarray, np.ndarray]:
    """Pseudo-counts (languages x runs, languages x singles) of the function words."""
    runs, singles = np.zeros((len(LANGS), RUNS)), np.zeros((len(LANGS), SINGLES))
    for k, g in enumerate(LANGS):
        _, r, s = features(lowered([FUNCTION_WORDS[g] or "".join(sorted(ZH_CHARS))]))
        np.add.at(runs[k], r, SEED)
        np.add.at(singles[k], s, SEED)
    for first, last, g in ((0x430, 0x44F, "ru"), (0x4E00, 0x9FFF, "zh")):  # every letter of a script is possible
        _, _, s = features(lowered(["".join(map(chr, range(first, last + 1)))]))
        np.add.at(singles[LANGS.index(g)], s, 1)
    return runs, singles


def tables(counts: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Log-probabilities (runs x classes, singles x classes) from counts by language, with the seeds."""
    out = []
    for k, seed in enumerate(seeds()):
        c = seed + (counts[k] if counts is not None else 0.0)
        pool = (c / np.maximum(1.0, c.sum(axis=1, keepdims=True))).mean(axis=0)  # languages weigh the same
        n = c.shape[1]
        base = (1 - UNIFORM) * pool + UNIFORM / n
        own = c.sum(axis=1, keepdims=True)
        lean = LEAN + LEAN_SHARE * own
        p = (c + lean * base) / (own + lean)
        other = (1 - OTHER_UNIFORM) * pool + OTHER_UNIFORM / n
        out.append(np.log(np.vstack([p, other])).T.astype(np.float32))
    return out[0], out[1]


def likelihoods(t: bulk.Text, model: tuple[np.ndarray, np.ndarray], starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log-likelihood by class, letters) of each stretch from one start to the next."""
    at, run, single = features(t)
    cut = np.searchsorted(at, starts)
    n = np.diff(np.append(cut, len(at)))
    ll = np.zeros((len(starts), len(CLASSES)), np.float32)
    some = np.flatnonzero(n)
    if len(some):
        values = model[0][run]
        values += model[1][single]
        lost = np.flatnonzero(t.codes[at] == 0xFFFD)
        if len(lost):  # a lost letter is no sign of another language
            values[lost, -1] = values[lost, :-1].mean(axis=1)
        ll[some] = np.add.reduceat(values, cut[some], axis=0)
    return ll * np.float32(TEMPER), n


def best(text: str, model: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[str | None, float]:
    """(language, probability) of a text as a whole; (None, 0.0) without letters."""
    ll, n = likelihoods(lowered([text]), model or tables(), np.zeros(1, np.int64))
    if not n[0]:
        return None, 0.0
    p = np.exp(ll[0] - ll[0].max())
    return CLASSES[int(p.argmax())], float(p.max() / p.sum())
