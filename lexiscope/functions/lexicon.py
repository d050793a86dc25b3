"""The closed lexicon of phrases and its categories, and other fixed word lists."""

from __future__ import annotations

import re

#: fixed values: phrases by category
PHRASES = {
    "A": ["ugly but it works", "ugly but works", "dirty hack", "ugly hack", "this is a hack", "hacky but works", "horrible but works", "terrible but works", "messy but works"],
    "B": ["ugly workaround", "dirty workaround", "quick and dirty", "crude but it works", "not pretty but it works", "band-aid fix", "duct tape fix", "temporary fix", "temp fix", "stopgap", "workaround for now"],
    "C": ["not ideal but it works", "not elegant but works", "ugly solution but", "ugly code but", "hope everything will work"],
}
#: fixed values: path parts and file names of third-party code
VENDORED_MARKERS = ["vendor/", "node_modules/", "third_party/", "thirdparty/", "external/", "extern/", "deps/", "Godeps/", "/src/golang.org/", "/src/github.com/", "site-packages/", "dist-packages/", ".venv/", "bower_components/", "dist/", "build/"]
VENDORED_FILES = [
    "jquery.js", "jquery.min.js", "jquery-ui.js", "jquery-ui.min.js", "bootstrap.js", "bootstrap.min.js", "bootstrap.bundle.js", "lodash.js", "lodash.min.js", "underscore.js", "underscore.min.js", "moment.js", "moment.min.js",
    "d3.js", "d3.min.js", "angular.js", "angular.min.js", "vue.js", "vue.min.js", "react.js", "react.min.js", "react-dom.js", "react-dom.min.js", "popper.js", "popper.min.js", "modernizr.js", "normalize.css", "search_index.js",
]
VERSION_FOLDER = r"(^|/)[A-Za-z][A-Za-z0-9_.]*-\d+\.\d+(\.\d+)?([./]|$)"
KNOWN_LIBRARIES = (
    "eigen zlib libpng peerjs jquery googletest gtest gmock catch2 nlohmann rapidjson boost curl openssl sqlite3 sqlite lua freetype harfbuzz angle skia llvm protobuf grpc abseil pybind11 fmtlib spdlog stb_image imgui glfw glew "
    "civetweb mongoose cjson cpp-httplib httplib cpython"
).split()
#: fixed values: automated accounts
BOT_LOGINS = ["dependabot", "renovate", "github-actions", "greenkeeper", "snyk-bot", "pull"]
#: fixed values: words after @ that are annotations or tags, not people
ANNOTATIONS = (
    "param return returns throws exception see code link author since version deprecated inheritdoc todo note warning override test component autowired inject requestmapping getmapping postmapping putmapping deletemapping entity column table id "
    "generatedvalue suppresswarnings jsonproperty jsonignore jsoninclude before after beforeeach aftereach beforeclass afterclass mock injectmocks data builder slf4j restcontroller controller service repository configuration bean value qualifier "
    "transactional valid notnull notempty size min max pattern getter setter noargsconstructor allargsconstructor requiredargsconstructor equalsandhashcode tostring functionalinterface safevarargs nullable nonnull visiblefortesting produces consumes "
    "pathvariable requestparam requestbody responsebody property staticmethod classmethod abstractmethod dataclass wraps lru_cache pytest fixture app click task injectable input output hostlistener viewchild ngmodule directive pipe"
).split()
#: fixed values: comment marks by file extension
LINE_COMMENTS = {"#": [".py", ".rb"], "//": [".java", ".js", ".ts", ".tsx", ".jsx", ".c", ".cpp", ".cc", ".h", ".hpp", ".go"]}
BLOCK_COMMENTS = {"/*": [".java", ".js", ".ts", ".tsx", ".jsx", ".c", ".cpp", ".cc", ".h", ".hpp", ".go"], '"""': [".py"], "'''": [".py"]}


def needle(phrase: str) -> str:
    """The phrase as the matcher compares it: lower case, one space for every run of other signs."""
    return re.sub(r"[^a-z0-9]+", " ", phrase.lower()).strip()


ENTRIES = [(p, c, needle(p), " " not in p) for c, ps in PHRASES.items() for p in ps]
CATEGORY = {p: c for p, c, _, _ in ENTRIES}
