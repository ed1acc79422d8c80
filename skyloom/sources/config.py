"""Options: `key = value` files, typed and range-checked; job options and tasks as JSON."""

from __future__ import annotations

import json
import warnings
from dataclasses import field, fields, make_dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F


#: Name, kind, default and, for numbers, the bounds that a value must lie between (exclusive).
REGISTRY = """
inputFile text
inputImage text img
fitsHDUId int 1 1 1000
outputFile text Output.root
ds9RegionFile text DS9SourceRegion.reg
saveDS9Region flag true
DS9RegionFormat int 2 0 3
ds9FitRegionFile text DS9SourceFitRegion.reg
saveToFile flag true
saveConfig flag true
saveResidualMap flag true
saveBkgMap flag true
saveNoiseMap flag true
saveSignificanceMap flag true
saveInputMap flag true
saveSaliencyMap flag true
saveSources flag true
saveEdgenessMap flag false
saveCurvatureMap flag false
saveSegmentedMap flag true
saveToFITSFile flag false
residualMapFITSFile text ResidualMap.fits
inputMapFITSFile text InputMap.fits
saliencyMapFITSFile text SaliencyMap.fits
bkgMapFITSFile text BkgMap.fits
noiseMapFITSFile text NoiseMap.fits
significanceMapFITSFile text SignificanceMap.fits
isInteractiveRun flag false
readTileImage flag false
tileMinX number 0 -1.e+6 1.e+6
tileMaxX number 0 -1.e+6 1.e+6
tileMinY number 0 -1.e+6 1.e+6
tileMaxY number 0 -1.e+6 1.e+6
beamFWHM number 6.5 0 3600
beamBmaj number 10 0 3600
beamBmin number 5 0 3600
beamTheta number 0 -0.0001 180
pixSize number 1 0 3600
splitInTiles flag false
nThreads int -1 -1 100
tileSizeX int 1000 1 10000000
tileSizeY int 1000 1 10000000
useTileOverlap flag false
tileStepSizeX number 1 0.001 1
tileStepSizeY number 1 0.001 1
mergeSourcesAtEdge flag true
mergeSources flag false
mergeCompactSources flag false
mergeExtendedSources flag false
loggerTarget int 1 1 3
loggerTag text logger
logLevel text INFO
logFile text out.log
appendToLogFile flag false
maxLogFileSize text 10MB
maxBackupLogFiles int 1 1 1000000
consoleTarget text System.out
syslogFacility text local6
useLocalBkg flag true
use2ndPassInLocalBkg flag true
skipOutliersInLocalBkg flag false
localBkgMethod int 1 1 2
bkgEstimator int 2 0 5
useBeamInfoInBkg flag true
boxSizeX number 20 0.01 1000
boxSizeY number 20 0.01 1000
gridSizeX number 0.2 0. 1.
gridSizeY number 0.2 0. 1.
usePreSmoothing flag true
smoothFilter int 2 1 2
gausFilterKernSize int 5 1 10001
gausFilterSigma number 1 0 1000
guidedFilterRadius number 12 0 1000
guidedFilterColorEps number 0.04 0 1000
searchCompactSources flag true
minNPix int 10 0 10000
seedThr number 5 0 10000
mergeThr number 2.6 0 10000
mergeBelowSeed flag false
searchNegativeExcess flag false
compactSourceSearchNIters int 10 0 100
seedThrStep number 1 0 10
searchNestedSources flag true
sourceToBeamAreaThrToSearchNested number 0 -0.001 100
nestedBlobThrFactor number 1 0 100
minNestedMotherDist number 2 0 100
maxMatchingPixFraction number 0.5 0 1
searchExtendedSources flag false
extendedSearchMethod int 2 0 10
useResidualInExtendedSearch flag true
wtScaleExtended int 6 1 10
wtScaleSearchMin int 3 1 10
wtScaleSearchMax int 6 1 10
activeContourMethod int 2 0 3
applySourceSelection flag true
sourceMinBoundingBox number 2 0 1000000
useMinBoundingBoxCut flag false
useCircRatioCut flag false
psCircRatioThr number 0.4 0 1
useElongCut flag false
psElongThr number 0.7 0 1
useEllipseAreaRatioCut flag false
psEllipseAreaRatioMinThr number 0.6 0 10
psEllipseAreaRatioMaxThr number 1.4 0 10
useMaxNPixCut flag false
psMaxNPix number 1000 0 1.e+7
useNBeamsCut flag false
psNBeamsThr number 5 -0.0001 1000
dilateZBrightThr number 10 0 10000
dilateZThr number 5 0 10000
dilateNestedSources flag true
dilateKernelSize int 9 1 1001
dilatedSourceType int 2 -1 3
dilateSourceModel int 1 1 2
dilateRandomize flag false
fitSources flag false
fitMaxNComponents int 3 0 100
fitWithCentroidLimits flag true
fitWithFixedBkg flag true
fitWithBkgLimits flag true
fitUseEstimatedBkgLevel flag true
fitBkgLevel number 0. -1.e+6 1.e+6
fitWithAmplLimits flag true
fitAmplLimit number 0.3 0 2
fitWithSigmaLimits flag true
fixSigmaInPreFit flag true
fitSigmaLimit number 0.3 0 2
fitWithFixedSigma flag false
fitWithThetaLimits flag true
fitWithFixedTheta flag false
fitThetaLimit number 5 0 360
useFluxZCutInFit flag false
fitZCutMin number 2.5 0 1000
peakMinKernelSize int 3 0 101
peakMaxKernelSize int 7 0 101
peakKernelMultiplicityThr int 1 0 100
peakShiftTolerance int 1 0 20
peakZThrMin number 1 0 1000
cvNIters int 1000 0 100000
cvTimeStepPar number 0.007 0 1000
cvWindowSizePar number 1 0 1000
cvLambda1Par number 1 0 100
cvLambda2Par number 2 0 100
cvMuPar number 0.5 0 100
cvNuPar number 0 0 100
cvPPar number 1 0 100
cvInitContourToSaliencyMap flag true
lracNIters int 1000 0 100000
lracLambdaPar number 0.1 0 1000
lracRadiusPar number 10 0 1000
lracEpsPar number 0.01 0 1000
lracInitContourToSaliencyMap flag true
saliencyThrFactor number 2.8 0 10
saliencyBkgThrFactor number 1 0.01 10
saliencyImgThrFactor number 1 0.01 10
saliencyResoMin int 20 1 1000
saliencyResoMax int 60 1 1000
saliencyResoStep int 10 1 100
saliencyUseRobustPars flag true
saliencyUseBkgMap flag true
saliencyUseNoiseMap flag true
saliencyUseCurvInDiss flag true
saliencyNNFactor number 0.2 0 1.0001
saliencySpatialRegFactor number 6 0 100
saliencyMultiResoCombThrFactor number 0.7 0 1
saliencyDissExpFalloffPar number 100 1.e-6 1.e+6
saliencySpatialDistRegPar number 1 0 1.e+6
spSize int 20 5 10000
spBeta number 1 1.e-10 1.e+10
spMinArea int 10 1 10000
spUseLogContrast flag false
spMergingNSegmentsToStop int 1 0 1000
spMergingRatio number 0.3 0 1.0001
spMergingMaxDissRatio number 1000 0 100000
spMergingMaxDissRatio2ndNeighbours number 1.05 0 100000
spMergingDissThreshold number 3 0 100000
spMergingEdgeModel int 2 1 2
spMergingRegPar number 0.5 -0.0001 1.0001
spMergingIncludeSpatialPars flag false
spMergingAddCurvDist flag true
spMergingUseRobustPars flag false
spMergingUse2ndNeighbours flag true
"""
COMMENTS = ("#", "*", "/")
_KINDS = {"text": str, "flag": bool, "int": int, "number": float}


def _value(kind: type, text: str):
    return text.lower() in ("true", "t", "1") if kind is bool else kind(text)


def _registered() -> tuple[list[tuple], dict[str, tuple[float, float]]]:
    known, limits = [], {}
    for line in REGISTRY.split("\n"):
        if line.strip():
            name, kind, *rest = line.split()
            known.append((name, _KINDS[kind], field(default=_value(_KINDS[kind], rest[0] if rest else ""))))
            if bounds := rest[1:]:
                limits[name] = (float(bounds[0]), float(bounds[1]))
    return known, limits


_FIELDS, LIMITS = _registered()
#: The options, all with their defaults.
Options = make_dataclass("Options", _FIELDS, module=__name__)


def parse(text: str) -> Options:
    """Options from lines `key = value`. Comments are skipped; so are, with a warning, unknown keys and values that are out of bounds or not of the option's kind."""
    out = Options()
    kinds = {name: kind for name, kind, _ in _FIELDS}
    for line in text.splitlines():
        line = line.strip()
        if not line or line.startswith(COMMENTS) or "=" not in line:
            continue
        key, value = (x.strip() for x in line.split("=", 1))
        if key not in kinds:
            warnings.warn(f"no option {key}")
            continue
        lo, hi = LIMITS.get(key, (float("-inf"), float("inf")))
        try:
            v = _value(kinds[key], value.split()[0] if value else "")
        except ValueError:
            warnings.warn(f"{key}: {value!r} is no {kinds[key].__name__}")
            continue
        if kinds[key] in (int, float) and not lo < v < hi:
            warnings.warn(f"{key} = {v} is not between {lo} and {hi}")
            continue
        setattr(out, key, v)
    return out


def as_table(spark: SparkSession, o: Options) -> DataFrame:
    return spark.createDataFrame([(f.name, type(getattr(o, f.name)).__name__, str(getattr(o, f.name))) for f in fields(o)], "name string, kind string, value string")


def valid_job(raw: str) -> bool:
    """A job's JSON needs a non-empty array `options` of objects with name and value."""
    try:
        opts = json.loads(raw).get("options")
    except (ValueError, AttributeError):
        return False
    return isinstance(opts, list) and bool(opts) and all(isinstance(o, dict) and "name" in o and "value" in o for o in opts)


TASK_SCHEMA = "filename string, jobId string, IdX long, IdY long, ix_min long, ix_max long, iy_min long, iy_max long"


def tasks_to_json(tasks: DataFrame) -> DataFrame:
    names = [x.split()[0] for x in TASK_SCHEMA.split(", ")]
    return tasks.select(F.to_json(F.struct(*names)).alias("value"))


def tasks_from_json(lines: DataFrame) -> DataFrame:
    """Tasks of JSON lines `value`; lines that lack a field or aren't JSON are left out."""
    t = lines.select(F.from_json("value", TASK_SCHEMA).alias("t")).select("t.*")
    return t.dropna()
