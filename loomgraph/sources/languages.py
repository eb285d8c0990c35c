"""Languages by file extension, and what the extractors know of each."""

from __future__ import annotations

from dataclasses import dataclass

#: Extensions of the supported languages.
EXTENSIONS = {
    "py": "python", "pyi": "python", "rs": "rust", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "go": "go", "java": "java", "cs": "csharp", "c": "c", "h": "c",
    "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "hh": "cpp", "swift": "swift", "php": "php", "html": "html", "htm": "html", "css": "css", "dart": "dart", "jl": "julia", "agc": "agc", "r": "r", "R": "r",
}
#: The languages in their order.
LANGUAGES = ("rust", "python", "typescript", "javascript", "go", "java", "csharp", "c", "cpp", "swift", "php", "html", "css", "dart", "julia", "agc", "r")
GROUPS = {"typescript": "js", "javascript": "js", "html": "js", "c": "c", "cpp": "c"}
#: Directories that a walk doesn't enter.
SKIPPED = ("node_modules", "target", "_build", "__pycache__", "venv", "env", "site-packages")
#: Names of everyday calls that say nothing about the graph; calls of these are no sites.
NOISE = {
    "c": """
        printf fprintf sprintf snprintf scanf sscanf puts fputs fgets getchar putchar malloc calloc realloc free exit abort atexit atoi atof memcpy memset
        memmove memcmp strlen strcmp strncmp strcpy strncpy strcat strstr strchr assert fopen fclose fread fwrite fseek ftell
    """.split(),
    "cpp": """
        printf fprintf sprintf snprintf scanf sscanf puts fputs fgets getchar putchar malloc calloc realloc free exit abort atexit atoi atof memcpy memset
        memmove memcmp strlen strcmp strncmp strcpy strncpy strcat strstr strchr assert fopen fclose fread fwrite fseek ftell size empty begin end cbegin cend
        rbegin rend push_back pop_back emplace_back push_front pop_front emplace_front insert erase find count at front back data resize reserve clear swap
        shrink_to_fit move forward make_shared make_unique get reset cout cerr endl static_cast dynamic_cast reinterpret_cast const_cast
    """.split(),
    "csharp": """
        ToString Equals GetHashCode CompareTo GetType ReferenceEquals MemberwiseClone Count Add Remove Contains Clear Insert ContainsKey TryGetValue Keys
        Values IndexOf CopyTo Any All Select Where FirstOrDefault First LastOrDefault Last Single SingleOrDefault ToList ToArray ToDictionary OrderBy
        OrderByDescending GroupBy Sum Max Min Average Aggregate Write WriteLine ReadLine Read Format Close Dispose Flush
    """.split(),
    "go": """
        len cap append copy delete make new close panic recover print println Error String Format Sprintf Fprintf Errorf Printf Println Print Fprintln Fprint
        Fatal Fatalf Fatalln
    """.split(),
    "java": """
        toString equals hashCode compareTo getClass notify notifyAll wait clone finalize length size get set add remove contains isEmpty put keySet values
        entrySet iterator next hasNext clear stream map filter collect forEach reduce flatMap sorted distinct limit println printf print format read write
        close flush
    """.split(),
    "julia": """
        include println error throw length size push! pop! sqrt abs min max clamp typeof convert collect isempty isnothing zeros ones rand get haskey keys
        values getindex setindex!
    """.split(),
    "php": """
        array count strlen isset empty unset print echo var_dump print_r gettype is_array is_string is_int is_bool is_null is_object is_callable trim explode
        implode str_replace preg_match json_encode json_decode in_array array_keys array_values array_map array_filter array_merge sprintf printf fopen fclose
        fread fwrite file_get_contents file_put_contents
    """.split(),
    "python": """
        len str int float bool list dict set tuple print isinstance issubclass type range enumerate zip map filter sorted reversed any all min max sum abs
        round hash id repr super getattr setattr hasattr delattr callable iter next open format append extend update pop get keys values items join split
        strip replace startswith endswith
    """.split(),
    "rust": """
        len is_empty contains get insert remove push pop clear extend iter next collect map filter with_capacity reserve clone to_string to_owned from into
        as_ref as_mut new default fmt eq ne cmp partial_cmp hash deref drop unwrap expect ok err map_err unwrap_or unwrap_or_else unwrap_or_default write
        writeln set
    """.split(),
    "swift": """
        print String Int Float Double Bool Array Dictionary Optional Range Result Error fatalError preconditionFailure assert precondition abs min max
    """.split(),
    "javascript": """
        push pop shift unshift map filter reduce forEach find findIndex some every includes indexOf slice splice concat join flat flatMap sort reverse keys
        values entries assign freeze hasOwnProperty toString valueOf trim split replace match test search startsWith endsWith substring toLowerCase
        toUpperCase then catch finally resolve reject log warn error info debug addEventListener removeEventListener querySelector getElementById
        createElement
    """.split(),
}
NOISE["typescript"] = NOISE["javascript"]


@dataclass(frozen=True)
class Shape:
    """How a brace (or `end`) language writes its definitions. The patterns have named groups: name, owner, params."""

    function: str
    type: str
    imports: str
    separator: str = "."
    block: str = "{"
    comment: str = "//"


_C_NOT = r"(?!(?:if|for|while|switch|return|catch|else|new|throw|sizeof|do)\b)"
SHAPES = {
    "rust": Shape(r"^[ \t]*(?P<vis>pub(?:\([^)]*\))?\s+)?(?:async\s+|const\s+|unsafe\s+|extern\s+\"\w+\"\s+)*fn\s+(?P<name>\w+)[^(]*\((?P<params>[^)]*)\)", r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?P<kind>struct|enum|trait|impl)(?:<[^>]*>)?\s+(?:(?P<base>[\w:]+)(?:<[^>]*>)?\s+for\s+)?(?P<name>\w+)", r"^[ \t]*(?:pub\s+)?use\s+([\w:]+)", "::"),
    "typescript": Shape(r"^[ \t]*(?:(?P<vis>export\s+(?:default\s+)?)?(?:async\s+)?function\s*\*?\s*(?P<name>\w+)\s*(?:<[^>]*>)?\((?P<params>[^)]*)\)|(?:export\s+)?(?:const|let|var)\s+(?P<arrow>\w+)\s*(?::[^=]+)?=\s*(?:async\s*)?\((?P<params2>[^)]*)\)\s*(?::[^=]+)?=>|(?:public\s+|private\s+|protected\s+|static\s+|async\s+)*(?P<method>" + _C_NOT + r"\w+)\s*\((?P<params3>[^)]*)\)\s*(?::[^{;]+)?(?=\{))", r"^[ \t]*(?:export\s+(?:default\s+)?)?(?:abstract\s+)?(?P<kind>class|interface|enum)\s+(?P<name>\w+)(?:<[^>]*>)?(?:\s+extends\s+(?P<base>[\w.]+))?(?:\s+implements\s+(?P<ifaces>[\w., ]+))?", r"(?:from|import|require\()\s*['\"]([^'\"]+)['\"]"),
    "go": Shape(r"^func\s+(?:\(\s*\w*\s*\*?(?P<owner>\w+)[^)]*\)\s*)?(?P<name>\w+)\s*(?:\[[^\]]*\])?\((?P<params>[^)]*)\)", r"^type\s+(?P<name>\w+)\s+(?P<kind>struct|interface)", r"^\s*(?:import\s+)?(?:\w+\s+)?\"([^\"]+)\"\s*$"),
    "java": Shape(r"^[ \t]*(?P<vis>public\s+|private\s+|protected\s+)?(?:static\s+|final\s+|abstract\s+|synchronized\s+)*(?:<[^>]*>\s*)?" + _C_NOT + r"[\w<>\[\], .?]+\s+(?P<name>\w+)\s*\((?P<params>[^)]*)\)\s*(?:throws[^{;]+)?(?=\{)", r"^[ \t]*(?:public\s+|private\s+|protected\s+|abstract\s+|final\s+|static\s+)*(?P<kind>class|interface|enum)\s+(?P<name>\w+)(?:<[^>]*>)?(?:\s+extends\s+(?P<base>\w+))?(?:<[^>]*>)?(?:\s+implements\s+(?P<ifaces>[\w, ]+))?", r"^\s*import\s+(?:static\s+)?([\w.]+)"),
    "csharp": Shape(r"^[ \t]*(?P<vis>public\s+|private\s+|protected\s+|internal\s+)?(?:static\s+|virtual\s+|override\s+|async\s+|sealed\s+)*" + _C_NOT + r"[\w<>\[\], .?]+\s+(?P<name>\w+)\s*\((?P<params>[^)]*)\)\s*(?=\{|=>)", r"^[ \t]*(?:public\s+|private\s+|internal\s+|abstract\s+|sealed\s+|static\s+|partial\s+)*(?P<kind>class|interface|enum|struct)\s+(?P<name>\w+)(?:<[^>]*>)?(?:\s*:\s*(?P<base>\w+)(?P<ifaces>(?:\s*,\s*\w+)*))?", r"^\s*using\s+(?:\w+\s*=\s*)?([\w.]+)\s*;"),
    "cpp": Shape(r"^[ \t]*(?:static\s+|inline\s+|virtual\s+|extern\s+(?:\"C\"\s+)?|constexpr\s+)*" + _C_NOT + r"[\w:<>*&, ]+?[\s*&]+(?:(?P<owner>\w+)::)?(?P<name>~?\w+)\s*\((?P<params>[^)]*)\)\s*(?:const\s*|noexcept\s*|override\s*)*(?=\{)", r"^[ \t]*(?P<kind>class|struct|enum)\s+(?:class\s+)?(?P<name>\w+)\s*(?::\s*(?:public|private|protected)?\s*(?P<base>[\w:]+))?\s*(?=\{)", r"^\s*#\s*include\s*([<\"][^>\"]+)[>\"]", "::"),
    "swift": Shape(r"^[ \t]*(?P<vis>public\s+|private\s+|internal\s+|open\s+|fileprivate\s+)?(?:static\s+|override\s+|mutating\s+|class\s+)*func\s+(?P<name>\w+)\s*(?:<[^>]*>)?\((?P<params>[^)]*)\)", r"^[ \t]*(?:public\s+|private\s+|final\s+|open\s+)*(?P<kind>class|struct|enum|protocol|extension)\s+(?P<name>\w+)(?:\s*:\s*(?P<base>\w+)(?P<ifaces>(?:\s*,\s*\w+)*))?", r"^\s*import\s+(\w+)"),
    "php": Shape(r"^[ \t]*(?P<vis>public\s+|private\s+|protected\s+)?(?:static\s+|final\s+|abstract\s+)*function\s+&?(?P<name>\w+)\s*\((?P<params>[^)]*)\)", r"^[ \t]*(?:abstract\s+|final\s+)?(?P<kind>class|interface|trait|enum)\s+(?P<name>\w+)(?:\s+extends\s+(?P<base>[\w\\]+))?(?:\s+implements\s+(?P<ifaces>[\w\\, ]+))?", r"^\s*use\s+([\w\\]+)", "\\"),
    "dart": Shape(r"^[ \t]*(?:static\s+|@override\s+)*" + _C_NOT + r"[\w<>?, ]+\s+(?P<name>\w+)\s*\((?P<params>[^)]*)\)\s*(?:async\*?\s*)?(?=\{|=>)", r"^[ \t]*(?:abstract\s+)?(?P<kind>class|mixin|enum)\s+(?P<name>\w+)(?:<[^>]*>)?(?:\s+extends\s+(?P<base>\w+))?(?:<[^>]*>)?(?:\s+(?:with|implements)\s+(?P<ifaces>[\w, ]+))?", r"^\s*(?:import|export|part)\s+'([^']+)'"),
    "julia": Shape(r"^[ \t]*function\s+(?:\w+\.)*(?P<name>\w+!?)\s*(?:\{[^}]*\})?\((?P<params>[^)]*)\)", r"^[ \t]*(?:mutable\s+)?(?P<kind>struct|abstract type)\s+(?P<name>\w+)(?:\{[^}]*\})?(?:\s*<:\s*(?P<base>\w+))?", r"^\s*(?:using|import)\s+([\w.]+)|include\(\"([^\"]+)\"\)", ".", "end", "#"),
    "r": Shape(r"^[ \t]*(?P<name>[\w.]+)\s*(?:<-|=)\s*function\s*\((?P<params>[^)]*)\)", r"setClass\(\s*[\"'](?P<name>\w+)[\"'](?P<kind>)(?:.*contains\s*=\s*[\"'](?P<base>\w+)[\"'])?", r"(?:library|require|source)\(\s*[\"']?([\w./]+)", "::", "{", "#"),
}
SHAPES["javascript"], SHAPES["c"] = SHAPES["typescript"], SHAPES["cpp"]
