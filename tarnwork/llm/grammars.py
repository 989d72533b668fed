"""Lexical rules and grammars of the languages whose files are checked.

Token classes: I name, N number, S string, NL line end, IN and OUT change of indentation,
BAD indentation or a character that no token can hold. Comments are left out before.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

DQ, SQ = r'"(?:[^"\\\n]|\\.|\\\n)*"', r"'(?:[^'\\\n]|\\.|\\\n)*'"
BLOCK_COMMENT, LINE_COMMENT = r"/\*[\s\S]*?\*/", r"//[^\n]*"


@dataclass(frozen=True)
class Language:
    strings: str
    comments: str
    keywords: str
    grammar: str
    operators: str = r"===|!==|\*\*=|>>>=|<<=|>>=|&&=|\|\|=|\?\?=|\.\.\.|=>|->|\+\+|--|&&|\|\||\?\?|\?\.|::|:=|<-|<=|>=|==|!=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|\*\*|<<|\.\.=|\.\."
    before: tuple = ()
    lines: str = "none"  # none, ends (line ends may end a statement), all, blocks (indentation)
    names: str = r"[A-Za-z_$\x80-\U0010ffff][\w$]*"
    numbers: str = r"(?:0[xXbBoO][0-9a-fA-F_]+|(?:\d[\d_]*(?:\.(?![.A-Za-z_])[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d+)?)[A-Za-z0-9_]*"
    goes_on: str = ""
    ender: str = ""
    extra: dict = field(default_factory=dict)


PYTHON = Language(
    strings=r"(?<![A-Za-z0-9_])(?:[rRbBuUfFtT]{1,2})?(?:\"\"\"(?:[^\"\\]|\\[\s\S]|\"(?!\"\"))*\"\"\"|'''(?:[^'\\]|\\[\s\S]|'(?!''))*'''|" + DQ + "|" + SQ + ")",
    comments=r"#[^\n]*",
    keywords="def class if elif else for while try except finally with as import from return raise pass break continue global nonlocal del assert in not and or is lambda async await yield",
    operators=r"\*\*=|//=|<<=|>>=|\.\.\.|->|:=|\*\*|//|<<|>>|<=|>=|==|!=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|@=",
    lines="blocks",
    names=r"[A-Za-z_\x80-\U0010ffff]\w*",
    numbers=r"(?:0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:{d}\.(?:{d})?|\.{d})(?:[eE][+-]?{d})?[jJ]?|{d}(?:[eE][+-]?{d})[jJ]?|{d}[jJ]|(?:[1-9](?:_?\d)*|0(?:_?0)*))(?!(?!(?:if|else|and|or|in|is|not|for)\b)\w)".replace("{d}", r"\d(?:_?\d)*"),
    before=((re.compile(r"\\\n"), " "), (re.compile(r"^([ \t]*)(?:match\b(?=[ \t]+[^=\n]*:[ \t]*(?:#[^\n]*)?$)|case\b(?=[ \t]+(?!(?:in|is|and|or|if|not|else)\b)[^\s=:.,)\]+*/%&|^<>!][^\n]*:))", re.M), r"\1while"), (re.compile(r"^([ \t]*)type(?=[ \t]+\w+[^=\n]*=)", re.M), r"\1del")),
    grammar=r"""
file = ( NL | stmt )* ;
stmt = small ( ';' small )* ';'? NL | compound ;
small = exprs | ( targets '=' )+ exprs | target1 ':' expr ( '=' exprs )? | target1 augop exprs | 'return' exprs? | 'raise' ( expr ( 'from' expr )? )? | 'pass' | 'break' | 'continue'
  | 'import' dotted alias? ( ',' dotted alias? )* | 'from' ( ( '.' | '...' )+ dotted? | dotted ) 'import' ( '*' | '(' I alias? ( ',' I alias? )* ','? ')' | I alias? ( ',' I alias? )* )
  | ( 'global' | 'nonlocal' ) I ( ',' I )* | 'del' targets ( '=' exprs )? | 'assert' expr ( ',' expr )? ;
augop = '+=' | '-=' | '*=' | '/=' | '//=' | '%=' | '**=' | '>>=' | '<<=' | '&=' | '|=' | '^=' | '@=' ;
dotted = I ( '.' I )* ;
alias = 'as' I ;
block = NL IN ( NL | stmt )+ OUT | small ( ';' small )* ';'? NL ;
compound = 'if' named ':' block ( 'elif' named ':' block )* ( 'else' ':' block )? | 'while' named ( ',' named )* ( 'if' named )? alias? ':' block ( 'else' ':' block )?
  | for | with | def | class | 'async' ( def | for | with ) | '@' named NL ( '@' named NL )* ( 'async'? def | class )
  | 'try' ':' block ( ( 'except' '*'? ( expr alias? )? ':' block )+ ( 'else' ':' block )? ( 'finally' ':' block )? | 'finally' ':' block ) ;
for = 'for' targets 'in' exprs ':' block ( 'else' ':' block )? ;
targets = target ( ',' target )* ','? ;
target = '*'? target1 ;
target1 = I | '(' targets? ')' | '[' targets? ']' | atom trailer* ( '.' I | '[' subs ']' ) ;
with = 'with' ( item ( ',' item )* | '(' item ( ',' item )* ','? ')' ) ':' block ;
item = expr ( 'as' target )? ;
def = 'def' I tparams? '(' params? ')' ( '->' expr )? ':' block ;
class = 'class' I tparams? ( '(' args? ')' )? ':' block ;
tparams = '[' subs ']' ;
params = pos ( ',' rest )? ','? | rest ','? ;
pos = plain ( ',' plain )* ( ',' '/' ( ',' plain )* ( ',' given )* | ( ',' given )+ ( ',' '/' ( ',' given )* )? )? | given ( ',' given )* ( ',' '/' ( ',' given )* )? ;
rest = '*' I ( ':' starred )? ( ',' keyed )* ( ',' last )? | '*' ( ',' keyed )+ ( ',' last )? | last ;
last = '**' I ( ':' expr )? ;
plain = I ( ':' expr )? ;
given = I ( ':' expr )? '=' expr ;
keyed = I ( ':' expr )? ( '=' expr )? ;
exprs = starred ( ',' starred )* ','? ;
starred = '*'? named | yield ;
yield = 'yield' ( 'from' expr | exprs )? ;
named = expr ( ':=' expr )? ;
expr = 'lambda' lparams? ':' expr | unary ( binop unary )* ( 'if' expr 'else' expr )? ;
lparams = lpos ( ',' lrest )? ','? | lrest ','? ;
lpos = I ( ',' I )* ( ',' '/' ( ',' I )* ( ',' lgiven )* | ( ',' lgiven )+ ( ',' '/' ( ',' lgiven )* )? )? | lgiven ( ',' lgiven )* ( ',' '/' ( ',' lgiven )* )? ;
lgiven = I '=' expr ;
lrest = '*' I ( ',' I ( '=' expr )? )* ( ',' '**' I )? | '*' ( ',' I ( '=' expr )? )+ ( ',' '**' I )? | '**' I ;
unary = ( '-' | '+' | '~' | 'not' | 'await' )* atom trailer* ;
binop = '+' | '-' | '*' | '/' | '//' | '%' | '@' | '**' | '<<' | '>>' | '&' | '|' | '^' | '<' | '>' | '<=' | '>=' | '==' | '!=' | 'and' | 'or' | 'in' | 'not' 'in' | 'is' 'not'? ;
atom = I | N | ( S | fields )+ | '...' | '(' inner? ')' | '[' inner? ']' | '{' ( pairs | inner )? '}' ;
fields = FS ( '(' exprs ')' )* FE ;
inner = starred ( comp+ | ( ',' starred )* ','? ) ;
comp = 'async'? 'for' targets 'in' unary ( binop unary )* ( 'if' unary ( binop unary )* )* ;
pairs = expr ':' expr comp+ | pair ( ',' pair )* ','? ;
pair = '**' expr | expr ':' expr ;
trailer = '.' I | '(' args? ')' | '[' subs ']' ;
args = named comp+ | arg ( ',' arg )* ( ',' karg )* ','? | karg ( ',' karg )* ','? ;
arg = '*' expr | named ;
karg = I '=' expr | '**' expr | '*' expr ;
subs = sub ( ',' sub )* ','? ;
sub = starred ( ':' expr? ( ':' expr? )? )? | ':' expr? ( ':' expr? )? ;
""",
)

_JS_EXPR = r"""
exprs = asg ( ',' asg )* ;
asg = unit ( binop unit )* ( '?' asg ':' asg )? ( ARROW '=>' ( block | asg ) )? ;
unit = pre* prim post* ;
pre = '+' | '-' | '!' | '~' | 'typeof' | 'void' | 'delete' | 'await' | 'new' | 'yield' '*'? | '++' | '--' | 'async' ;
prim = id | N | S | 'this' | 'super' | 'import' | '(' args? ')' | '[' elems ']' | '{' props? '}' | 'async'? 'function' '*'? id? tparams? '(' params? ')' rtype? block | 'class' id? tparams? heritage classbody GENERIC ;
post = '.' anyid | '?.' ( anyid | '(' args? ')' | '[' exprs ']' ) | '(' args? ')' | '[' exprs ']' | '++' | '--' TSPOST ;
binop = '+' | '-' | '*' | '/' | '%' | '**' | '<' | '>' '>'* '='? | '<=' | '>=' | '==' | '!=' | '===' | '!==' | '&&' | '||' | '??' | '&' | '|' | '^' | '<<' | 'instanceof' | 'in'
  | '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '**=' | '<<=' | '>>=' | '>>>=' | '&=' | '|=' | '^=' | '&&=' | '||=' | '??=' ;
args = arg ( ',' arg )* ','? ;
arg = '...'? asg ARGTYPE ;
elems = ( '...'? asg )? ( ',' ( '...'? asg )? )* ;
props = prop ( ',' prop )* ','? ;
prop = '...' asg | ( 'async' | 'get' | 'set' | '*' )* key ( ':' asg | tparams? '(' params? ')' rtype? block | '=' asg )? ;
key = anyid | S | N | '[' asg ']' ;
params = param ( ',' param )* ','? ;
param = ( '@' I )* PMOD '...'? bind ARGQ ptype? ( '=' asg )? ;
bind = id | 'this' | '[' ( bind ( '=' asg )? )? ( ',' ( '...'? bind ( '=' asg )? )? )* ']' | '{' ( '...'? bkey ( ',' '...'? bkey )* ','? )? '}' ;
bkey = key ( ':' bind )? ( '=' asg )? ;
"""
_JS_STMT = r"""
block = '{' stmts '}' ;
stmts = ( closed | open end | end )* open? ;
end = ';' | NL ;
closed = block | 'if' '(' exprs ')' body ( NL? 'else' body )? | 'for' 'await'? '(' forhead ')' body | 'while' '(' exprs ')' body | 'with' '(' exprs ')' body
  | 'do' body 'while' '(' exprs ')' end? | 'switch' '(' exprs ')' '{' ( 'case' exprs ':' stmts | 'default' ':' stmts )* '}' | 'try' block NL? ( 'catch' ( '(' bind ptype? ')' )? block )? ( NL? 'finally' block )?
  | function | class | 'export' ( 'default' ( function | class | open end? ) | function | class TSEXPORT ) TSCLOSED ;
body = closed | open end? | ';' ;
function = 'async'? 'function' '*'? id? tparams? '(' params? ')' rtype? ( block FNSIG ) ;
class = ABSTRACT 'class' id? tparams? heritage classbody ;
heritage = ( 'extends' unit targs? )? IMPLEMENTS ;
classbody = '{' ( NL | ';' | member )* '}' ;
member = decor* MMOD ( 'static' | 'async' | 'get' | 'set' | '*' )* ( key | PRIV key ) ARGQ ( tparams? '(' params? ')' rtype? ( block SIGEND ) | ptype? ( '=' asg )? ( end ) ) | 'static' block ;
PRIVATE_UNUSED = 'never' ;
decor = '@' I ( '.' I )* ( '(' args? ')' )? NL? ;
open = exprs | ( 'var' | 'let' | 'const' ) decl ( ',' decl )* | 'return' exprs? | 'throw' exprs | ( 'break' | 'continue' ) I? | 'debugger'
  | 'import' ( S | '(' exprs ')' post* | TYPEONLY ( id | '*' 'as' id | '{' imports? '}' ) ( ',' ( '*' 'as' id | '{' imports? '}' ) )? 'from' S )
  | 'export' ( TYPEONLY '{' imports? '}' ( 'from' S )? | '*' ( 'as' id )? 'from' S | ( 'var' | 'let' | 'const' ) decl ( ',' decl )* ) | I ':' ( closed | open )? TSOPEN ;
decl = bind DEF ptype? ( '=' asg )? ;
imports = ispec ( ',' ispec )* ','? ;
ispec = TYPEONLY ( anyid | S ) ( 'as' anyid )? ;
forhead = ( open )? ';' exprs? ';' exprs? | ( 'var' | 'let' | 'const' )? forbind ( 'of' | 'in' ) exprs ;
forbind = bind | unit ;
"""
_JS_KEYS = "var let const function return if else for while do switch case default break continue new delete typeof instanceof in class extends import export async await yield throw try catch finally this super void static get set of from as with debugger"
_TS_KEYS = _JS_KEYS + " interface type enum namespace declare abstract implements public private protected readonly keyof is infer override satisfies asserts module unique"
_SOFT_JS = ["of", "from", "as", "get", "set", "static", "async", "let", "await", "yield"]
_SOFT_TS = _SOFT_JS[:7] + ["type", "namespace", "declare", "abstract", "is", "infer", "override", "satisfies", "asserts", "module", "unique", "keyof", "readonly", "public", "private", "protected", "interface", "enum", "implements"]


def _script(keys: str, soft: list[str], typed: bool) -> str:
    words = " | ".join(f"'{k}'" for k in keys.split())
    ids = f"id = I | {' | '.join(repr(k) for k in soft)} ;\nanyid = I | {words} | '#' I ;\n"
    text = "file = stmts ;\n" + ids + _JS_STMT + _JS_EXPR
    if typed:
        fill = {
            " TSPOST": "| '!' | 'as' type | 'satisfies' type | targs '(' args? ')'", "ARGTYPE": "'?'? ptype? ( '=' asg )?", "PMOD": "( 'public' | 'private' | 'protected' | 'readonly' | 'override' )*",
            "ARROW": "rtype?", "GENERIC": "| tparams '(' params? ')'", "ARGQ": "( '?' | '!' )?", "DEF": "'!'?", "TSEXPORT": "| tsdecl | 'async'? 'function' id tparams? '(' params? ')' rtype? end", "TSCLOSED": "| tsdecl | decor+ ( 'export' 'default'? )? class", "FNSIG": "| end",
            "ABSTRACT": "'declare'? 'abstract'?", "IMPLEMENTS": "( 'implements' type ( ',' type )* )?", "MMOD": "( 'public' | 'private' | 'protected' | 'readonly' | 'abstract' | 'override' | 'declare' )*",
            "SIGEND": "| end", "TYPEONLY": "'type'?", "TSOPEN": "| 'type' I tparams? '=' '|'? type | 'export' 'type' I tparams? '=' '|'? type | 'declare' ( 'var' | 'let' | 'const' ) decl",
        }
        text += r"""
ptype = ':' type ;
rtype = ':' 'asserts'? type ;
tparams = '<' tparam ( ',' tparam )* ','? '>' ;
tparam = 'const'? I ( 'extends' type )? ( '=' type )? ;
targs = '<' type ( ',' type )* '>' ;
type = tunit ( ( '|' | '&' | 'is' ) tunit )* ( 'extends' type '?' type ':' type )? ;
tunit = ( 'keyof' | 'readonly' | 'typeof' | 'unique' | 'infer' | 'new' | 'abstract' | '-' )* tprim ( '[' type? ']' )* ;
tprim = I ( '.' I )* targs? | 'import' '(' S ')' ( '.' I )* | S | N | 'this' | 'void' | '{' ( tmember ( ';' | ',' | NL )* )* '}' | '(' params? ')' ( '=>' type )? | '(' type ')' | tparams '(' params? ')' '=>' type | '[' ( tel ( ',' tel )* ','? )? ']' ;
tel = '...'? ( I '?'? ':' )? type '?'? ;
tmember = ( 'readonly' | 'get' | 'set' | '-' | '+' )* ( key '?'? ( tparams? '(' params? ')' rtype? | ptype )? | tparams? '(' params? ')' rtype? | '[' I ( ':' | 'in' ) type ( 'as' type )? ']' ( '-' | '+' )? '?'? ptype | 'new' '(' params? ')' rtype ) ;
tsdecl = 'declare'? ( 'interface' I tparams? ( 'extends' type ( ',' type )* )? '{' ( NL | ';' | ',' | tmember )* '}' | 'const'? 'enum' I '{' ( NL | I ( '=' asg )? | S ( '=' asg )? | ',' )* '}' | ( 'namespace' | 'module' ) ( I ( '.' I )* | S ) block ) ;
"""
    else:
        fill = dict.fromkeys(["ARROW", "GENERIC", "TSPOST", "ARGTYPE", "PMOD", "ARGQ", "DEF", "TSEXPORT", "TSCLOSED", "FNSIG", "ABSTRACT", "IMPLEMENTS", "MMOD", "SIGEND", "TYPEONLY", "TSOPEN"], "")
        for gone in (" tparams?", " rtype?", " ptype?", " targs?"):
            text = text.replace(gone, "")
    text = text.replace("( key | PRIV key )", "key").replace("PRIVATE_UNUSED = 'never' ;\n", "")
    text = text.replace("| S TSPOST ;", "| S TSPOST ;")
    for k, v in fill.items():
        text = re.sub(rf"{k.strip()}\b", v.strip(), text)
    return text


_JS_STRINGS = DQ + "|" + SQ + r"|`(?:[^`\\]|\\[\s\S])*`"
_JS_REGEX = (re.compile(r"((?:[=(,:\[!&|?{};]|\breturn|\btypeof|=>)[ \t]*)/(?![*/ ])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*"), r"\1``")
JAVASCRIPT = Language(strings=_JS_STRINGS, comments=BLOCK_COMMENT + "|" + LINE_COMMENT, keywords=_JS_KEYS, lines="ends", goes_on=".?:*/%&|,)]=<>+-^;", before=((re.compile(r"\A#![^\n]*"), ""), _JS_REGEX), grammar=_script(_JS_KEYS, _SOFT_JS, False))
TYPESCRIPT = Language(strings=_JS_STRINGS, comments=BLOCK_COMMENT + "|" + LINE_COMMENT, keywords=_TS_KEYS, lines="ends", goes_on=".?:*/%&|,)]=<>+-^;", before=((re.compile(r"\A#![^\n]*"), ""), _JS_REGEX), grammar=_script(_TS_KEYS, _SOFT_TS, True))

GO = Language(
    strings=DQ + "|`[^`]*`|" + SQ, comments=BLOCK_COMMENT + "|" + LINE_COMMENT,
    keywords="package import func return if else for range switch case default select go defer var const type struct interface map chan break continue goto fallthrough",
    lines="ends", ender="ISN)]}",
    operators=r"<<=|>>=|&\^=|\.\.\.|<-|:=|&&|\|\||\+\+|--|<=|>=|==|!=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|&\^",
    grammar=r"""
file = end* 'package' I end ( end | import )* ( end | top )* ;
end = ';' | NL ;
import = 'import' ( spec | '(' ( end | spec end )* spec? ')' ) end ;
spec = ( I | '.' )? S ;
top = ( func | decl ) end? ;
func = 'func' ( '(' params? ')' )? I tparams? sig block? ;
tparams = '[' I ( ',' I )* tconstraint ( ',' I ( ',' I )* tconstraint )* ','? ']' ;
tconstraint = '~'? type ( '|' '~'? type )* ;
sig = '(' params? ')' ( '(' params? ')' | type )? ;
params = param ( ',' param )* ','? ;
param = I ( '...'? type )? | '...'? typex ;
decl = ( 'var' | 'const' ) ( vspec | '(' ( end | vspec end )* vspec? ')' ) | 'type' ( tspec | '(' ( end | tspec end )* ')' ) ;
vspec = I ( ',' I )* type? ( '=' exprs )? ;
tspec = I ( '[' I tconstraint ( ',' I tconstraint )* ']' )? '='? type ;
type = I ( '.' I )? ( '[' type ( ',' type )* ']' )? | typex ;
typex = '*' type | '[' ( expr | '...' )? ']' type | 'map' '[' type ']' type | '<-'? 'chan' '<-'? type | 'func' sig | '(' type ')' | I '.' I ( '[' type ( ',' type )* ']' )?
  | 'struct' '{' ( end | field end )* field? '}' | 'interface' '{' ( end | method end )* method? '}' ;
field = ( I ( ',' I )* type | '*'? I ( '.' I )? ) S? ;
method = I sig | tconstraint ;
block = '{' stmts '}' ;
stmts = ( end | stmt end )* stmt? ;
stmt = simple | decl | 'return' exprs? | 'if' cond block ( 'else' ( block | elseif ) )? | 'for' ( cond | forclause | range )? block | 'switch' swhead '{' ( end | clause )* '}' | 'select' '{' ( end | clause )* '}'
  | ( 'go' | 'defer' ) expr | ( 'break' | 'continue' | 'goto' ) I? | 'fallthrough' | block | I ':' ;
elseif = 'if' cond block ( 'else' ( block | elseif ) )? ;
clause = ( 'case' ( exprs | simple | type ( ',' type )* ) | 'default' ) ':' stmts ;
cond = ( simple? ';' )? cexpr ;
forclause = csimple? ';' cexpr? ';' csimple? ;
range = ( cexprs ( ':=' | '=' ) )? 'range' cexpr ;
swhead = ( csimple? ';' )? csimple? ;
simple = exprs ( ( ':=' | '=' | op ) exprs | '++' | '--' | '<-' expr )? ;
csimple = cexprs ( ( ':=' | '=' | op ) cexprs | '++' | '--' )? ;
op = '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>>=' | '&^=' ;
exprs = expr ( ',' expr )* ;
cexprs = cexpr ( ',' cexpr )* ;
expr = unary ( binop unary )* ;
cexpr = cunary ( binop cunary )* ;
unary = pre* prim post* lit? post* ;
cunary = pre* prim post* ;
pre = '-' | '+' | '!' | '^' | '*' | '&' | '<-' ;
binop = '+' | '-' | '*' | '/' | '%' | '&' | '|' | '^' | '<<' | '>>' | '&^' | '&&' | '||' | '==' | '!=' | '<' | '<=' | '>' | '>=' ;
prim = I | N | S | '(' ( expr | bare ) ')' | 'func' sig block | ctype lit? ;
bare = '*' type | '[' ( expr | '...' )? ']' type | 'map' '[' type ']' type | '<-'? 'chan' '<-'? type | 'func' sig | 'struct' '{' ( end | field end )* field? '}' | 'interface' '{' ( end | method end )* method? '}' ;
ctype = '[' ( expr | '...' )? ']' type | 'map' '[' type ']' type | 'struct' '{' ( end | field end )* field? '}' | 'interface' '{' '}' | 'chan' type ;
lit = '{' ( elem ( ',' NL? elem )* )? ','? NL? '}' ;
elem = ( expr | lit ) ( ':' ( expr | lit ) )? ;
post = '.' ( I | '(' ( type | 'type' ) ')' ) | '(' ( args )? ')' | '[' ( expr | ctype )? ( ':' expr? )? ( ':' expr )? ( ',' type )* ']' ;
args = arg ( ',' arg )* ','? ;
arg = ( expr | typex ) '...'? ;
""",
)

JAVA = Language(
    strings=r"\"\"\"[\s\S]*?\"\"\"|" + DQ + "|" + SQ, comments=BLOCK_COMMENT + "|" + LINE_COMMENT,
    keywords="package import class interface enum record extends implements public private protected static final abstract native synchronized transient volatile strictfp default sealed permits throws throw return if else for while do switch case break continue new instanceof try catch finally this super assert yield",
    operators=r"<<=|>>=|\.\.\.|->|::|&&|\|\||\+\+|--|<=|>=|==|!=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<",
    grammar=r"""
file = ( annot* 'package' qname ';' )? ( 'import' 'static'? qname ( '.' '*' )? ';' | ';' )* ( typedecl | ';' )* ;
id = I | 'record' | 'sealed' | 'permits' | 'yield' ;
qname = id ( '.' id )* ;
annot = '@' qname ( '(' aargs? ')' )? ;
aargs = aval ( ',' aval )* ;
aval = expr | '{' ( aval ( ',' aval )* ','? )? '}' | annot ;
mods = ( annot | 'public' | 'private' | 'protected' | 'static' | 'final' | 'abstract' | 'native' | 'synchronized' | 'transient' | 'volatile' | 'strictfp' | 'default' | 'sealed' )* ;
typedecl = mods typebody ;
typebody = 'class' id tparams? ( 'extends' type )? ( 'implements' types )? ( 'permits' types )? body | 'interface' id tparams? ( 'extends' types )? ( 'permits' types )? body | '@' 'interface' id body
  | 'record' id tparams? '(' params? ')' ( 'implements' types )? body | 'enum' id ( 'implements' types )? '{' ( econst ( ',' econst )* )? ','? ( ';' member* )? '}' ;
econst = annot* id ( '(' args? ')' )? body? ;
body = '{' member* '}' ;
member = ';' | 'static'? block | mods ( typebody | tparams? type ( id dims ( ( '=' vinit )? ( ',' id dims ( '=' vinit )? )* ';' | '(' params? ')' dims ( 'throws' types )? ( block | ( 'default' aval )? ';' ) ) | '(' params? ')' ( 'throws' types )? block ) ) ;
dims = ( '[' ']' )* ;
tparams = '<' tparam ( ',' tparam )* '>' ;
tparam = id ( 'extends' type ( '&' type )* )? ;
types = type ( ',' type )* ;
type = annot* id targs? ( '.' id targs? )* ( '[' ']' )* ;
targs = '<' ( targ ( ',' targ )* )? '>' ;
targ = type | '?' ( ( 'extends' | 'super' ) type )? ;
params = param ( ',' param )* ;
param = ( annot | 'final' )* type '...'? ( id | 'this' ) dims ;
block = '{' stmt* '}' ;
stmt = block | ';' | local ';' | expr ';' | 'if' '(' expr ')' stmt ( 'else' stmt )? | 'for' '(' forhead ')' stmt | 'while' '(' expr ')' stmt | 'do' stmt 'while' '(' expr ')' ';' | 'return' expr? ';' | 'throw' expr ';'
  | ( 'break' | 'continue' ) id? ';' | 'yield' expr ';' | 'assert' expr ( ':' expr )? ';' | 'synchronized' '(' expr ')' block | switch | id ':' stmt | mods typebody
  | 'try' ( '(' res ( ';' res )* ';'? ')' )? block ( 'catch' '(' 'final'? type ( '|' type )* id ')' block )* ( 'finally' block )? ;
res = 'final'? type id '=' expr | expr ;
local = ( annot | 'final' )* type id dims ( '=' vinit )? ( ',' id dims ( '=' vinit )? )* ;
vinit = expr | '{' ( vinit ( ',' vinit )* )? ','? '}' ;
forhead = ( local | expr ( ',' expr )* )? ';' expr? ';' ( expr ( ',' expr )* )? | ( annot | 'final' )* type id ':' expr ;
switch = 'switch' '(' expr ')' '{' ( ( 'case' pat ( ',' pat )* | 'default' ) ( ':' stmt* | '->' ( expr ';' | block | 'throw' expr ';' ) ) )* '}' ;
pat = cexpr ( id )? | 'default' ;
cexpr = cunit ( binop cunit )* ;
cunit = pre* prim post* ;
expr = unit ( binop unit | 'instanceof' 'final'? type ( id | '(' params ')' )? )* ( '?' expr ':' expr )? ;
unit = pre* prim post* ( '->' ( expr | block ) )? ;
pre = '+' | '-' | '!' | '~' | '++' | '--' | '(' type ( '&' type )* ')' ;
prim = id targs? | N | S | 'this' | 'super' | '(' ( expr | lparams )? ')' | 'new' newtype | switch | id dims2 ;
dims2 = ( '[' ']' )+ ;
newtype = annot* id targs? ( '.' id targs? )* ( '(' args? ')' body? | ( '[' expr? ']' )+ ( '{' ( vinit ( ',' vinit )* )? ','? '}' )? ) ;
lparams = expr ( ',' expr )+ | params ;
post = '.' ( id | 'class' | 'this' | 'super' | 'new' newtype | targs id ) | '(' args? ')' | '[' expr ']' | '++' | '--' | '::' ( id | 'new' ) ;
args = expr ( ',' expr )* ;
binop = '+' | '-' | '*' | '/' | '%' | '<' | '>' '>'* '='? | '<=' | '>=' | '==' | '!=' | '&&' | '||' | '&' | '|' | '^' | '<<' | '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '<<=' | '>>=' | '&=' | '|=' | '^=' ;
""",
)

C = Language(
    strings=r"(?<![A-Za-z0-9_])(?:u8|[uUL])?" + DQ + r"|(?:[uUL])?'(?:[^'\\\n]|\\.)+'", comments=BLOCK_COMMENT + "|" + LINE_COMMENT,
    keywords="struct union enum typedef static extern const volatile register inline unsigned signed if else for while do switch case default break continue return goto sizeof restrict",
    operators=r"<<=|>>=|\.\.\.|->|&&|\|\||\+\+|--|<=|>=|==|!=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>",
    before=((re.compile(r"^[ \t]*#[ \t]*(?:include\b[ \t]*(?:<[^>\n]*>|\"[^\"\n]*\")|(?:define|undef|ifdef|ifndef)[ \t]+\w+(?:\\\n|[^\n\\]|\\.)*|(?:if|elif|error|warning|pragma|line)\b(?:\\\n|[^\n\\]|\\.)*|(?:else|endif)\b[^\n]*)$", re.M), ""),),
    grammar=r"""
file = ( external | ';' )* ;
external = 'typedef' specs declr ( ',' declr )* ';' | specs ( ';' | declr attrs ( block | ( '=' init )? ( ',' declr ( '=' init )? )* ';' ) ) ;
attrs = ( I '(' args? ')' )? ;
specs = spec+ ;
spec = 'static' | 'extern' S? | 'const' | 'volatile' | 'register' | 'inline' | 'unsigned' | 'signed' | 'restrict' | I | ( 'struct' | 'union' ) ( I ( '{' fields '}' )? | '{' fields '}' ) | 'enum' ( I ( '{' enums '}' )? | '{' enums '}' ) ;
fields = ( specs ( fdeclr ( ',' fdeclr )* )? ';' )* ;
fdeclr = declr ( ':' expr )? ;
enums = I ( '=' expr )? ( ',' I ( '=' expr )? )* ','? ;
declr = ptr* ( I | '(' declr ')' ) dsuf* ;
ptr = '*' ( 'const' | 'volatile' | 'restrict' )* ;
dsuf = '[' ( 'static'? expr )? ']' | '(' params? ')' ;
params = param ( ',' param )* ;
param = specs ( declr | adeclr )? | '...' ;
adeclr = ptr+ ( '(' adeclr? ')' )? dsuf* | dsuf+ ;
init = expr | '{' ( ielem ( ',' ielem )* )? ','? '}' ;
ielem = ( ( '.' I | '[' expr ']' )+ '=' )? init ;
block = '{' stmt* '}' ;
stmt = block | ';' | exprs ';' | 'typedef'? specs ( declr ( '=' init )? ( ',' declr ( '=' init )? )* )? ';' | 'if' '(' exprs ')' stmt ( 'else' stmt )? | 'for' '(' ( exprs ';' | specs declr ( '=' init )? ( ',' declr ( '=' init )? )* ';' | ';' ) exprs? ';' exprs? ')' stmt
  | 'while' '(' exprs ')' stmt | 'do' stmt 'while' '(' exprs ')' ';' | 'switch' '(' exprs ')' stmt | 'case' expr ':' | 'default' ':' | 'return' exprs? ';' | 'goto' I ';' | ( 'break' | 'continue' ) ';' | I ':' ;
exprs = expr ( ',' expr )* ;
expr = unit ( binop unit )* ( '?' exprs ':' expr )? ;
unit = pre* prim post* ;
pre = '+' | '-' | '!' | '~' | '*' | '&' | '++' | '--' | 'sizeof' | '(' tname ')' ;
tname = specs adeclr? ;
prim = I S* | N | S ( S | I )* | '(' ( exprs | tname | block ) ')' | '(' tname ')' '{' ( ielem ( ',' ielem )* )? ','? '}' ;
post = '.' I | '->' I | '(' args? ')' | '[' exprs ']' | '++' | '--' ;
args = ( expr | tname ) ( ',' ( expr | tname ) )* ;
binop = '+' | '-' | '*' | '/' | '%' | '<' | '>' | '<=' | '>=' | '==' | '!=' | '&&' | '||' | '&' | '|' | '^' | '<<' | '>>' | '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '<<=' | '>>=' | '&=' | '|=' | '^=' ;
""",
)

RUST = Language(
    strings=r"(?<![A-Za-z0-9_])b?c?r(?P<h>#+)\"[\s\S]*?\"(?P=h)|(?<![A-Za-z0-9_])b?c?r\"[^\"]*\"|(?<![A-Za-z0-9_])[bc]?\"(?:[^\"\\]|\\[\s\S])*\"|b?'(?:[^'\\\n]|\\(?:[^u\n]|u\{[^}\n]*\}|x..))'",
    comments=r"/\*(?:[^*/]|\*(?!/)|/(?!\*)|/\*[\s\S]*?\*/)*\*/|//[^\n]*",
    keywords="fn let mut const static if else match for while loop in return break continue struct enum union_ impl trait type use mod pub where as ref move unsafe async await dyn extern crate self super",
    operators=r"<<=|>>=|\.\.\.|\.\.=|\.\.|=>|->|::|&&|\|\||<=|>=|==|!=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<",
    before=((re.compile(r"(?<![\w'])'(?:[a-z_]\w*)(?!')"), "~"),),
    grammar=r"""
file = iattr* item* ;
iattr = '#' '!' '[' soup ']' ;
attr = '#' '!'? '[' soup ']' ;
soup = ( any | '(' soup ')' | '[' soup ']' | '{' soup '}' )* ;
any = I | N | S | '=' | ',' | '.' | ':' | '::' | '!' | '-' | '+' | '*' | '/' | '<' | '>' | '&' | '|' | '?' | ';' | '$' | '@' | '#' | '~' | '%' | '^' | '=>' | '->' | '..' | '..=' | '...' | '&&' | '||' | '<=' | '>=' | '==' | '!=' | '+=' | '-=' | '*=' | '/=' | '<<' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>>='
  | 'fn' | 'let' | 'mut' | 'const' | 'static' | 'if' | 'else' | 'match' | 'for' | 'while' | 'loop' | 'in' | 'return' | 'break' | 'continue' | 'struct' | 'enum' | 'impl' | 'trait' | 'type' | 'use' | 'mod' | 'pub' | 'where' | 'as' | 'ref' | 'move' | 'unsafe' | 'async' | 'await' | 'dyn' | 'extern' | 'crate' | 'self' | 'super' ;
vis = 'pub' ( '(' ( 'crate' | 'self' | 'super' | 'in' path ) ')' )? ;
item = attr* vis? ( fn | 'use' utree ';' | 'extern'? 'mod' I ( ';' | '{' iattr* item* '}' ) | 'extern' 'crate' I ( 'as' I )? ';' | 'type' I gparams? ( ':' bounds )? where ( '=' type )? where ';' | ( 'const' | 'static' 'mut'? ) I ':' type ( '=' expr )? ';'
  | 'struct' I gparams? ( where '{' sfields? '}' | '(' tfields? ')' where ';' | ';' ) | 'enum' I gparams? where '{' ( variant ( ',' variant )* ','? )? '}' | 'unsafe'? 'impl' gparams? '!'? type ( 'for' type )? where '{' item* '}'
  | 'unsafe'? 'trait' I gparams? ( ':' bounds )? where '{' item* '}' | 'unsafe'? 'extern' S? '{' item* '}' | path '!' I? ( '{' soup '}' | ( '(' soup ')' | '[' soup ']' ) ';' ) ) ;
fn = ( 'const' | 'async' | 'unsafe' | 'extern' S? )* 'fn' I gparams? '(' fparams? ')' ( '->' type )? where ( block | ';' ) ;
fparams = fparam ( ',' fparam )* ','? ;
fparam = attr* ( '&' '~'? 'mut'? 'self' | 'mut'? 'self' ( ':' type )? | pattern ':' type ) ;
gparams = '<' ( gparam ( ',' gparam )* ','? )? '>' ;
gparam = '~' ( ':' bounds? )? | I ( ':' bounds? )? ( '=' type )? | 'const' I ':' type ( '=' expr )? ;
where = ( 'where' ( wpred ( ',' wpred )* ','? )? )? ;
wpred = ( '~' | ( 'for' gparams )? type ) ':' bounds? ;
bounds = bound ( '+' bound )* ;
bound = '~' | '?'? ( 'for' gparams )? path | '(' '?'? path ')' ;
utree = '::'? ( useg ( '::' useg )* ( '::' ( '*' | '{' ( utree ( ',' utree )* ','? )? '}' ) )? ( 'as' I )? | '{' ( utree ( ',' utree )* ','? )? '}' | '*' ) ;
useg = I | 'self' | 'super' | 'crate' ;
sfields = sfield ( ',' sfield )* ','? ;
sfield = attr* vis? I ':' type ;
tfields = attr* vis? type ( ',' attr* vis? type )* ','? ;
variant = attr* I ( '(' tfields? ')' | '{' sfields? '}' )? ( '=' expr )? ;
path = '::'? pseg ( '::' ( pseg | gargs ) )* ;
pseg = ( I | 'self' | 'super' | 'crate' ) ( gargs | '(' ( type ( ',' type )* ','? )? ')' ( '->' type )? )? ;
gargs = '<' ( garg ( ',' garg )* ','? )? '>' ;
garg = type ( '=' type | ':' bounds )? | '~' | N | S | block ;
type = tunit ( '+' bound )* ;
tunit = path | '&' '~'? 'mut'? tunit | '&&' '~'? 'mut'? tunit | '*' ( 'const' | 'mut' ) tunit | '(' ( type ( ',' type )* ','? )? ')' | '[' type ( ';' expr )? ']' | 'dyn' bounds | 'impl' bounds | '!' | ( 'unsafe' | 'extern' S? )* 'fn' '(' ( type ( ',' type )* ','? )? ')' ( '->' type )? | '<' type ( 'as' path )? '>' '::' path ;
block = '{' iattr* stmts '}' ;
stmts = ( ';' | attr* ( 'let' pattern ( ':' type )? ( '=' expr ( 'else' block )? )? ';' | closed | open ';' | itemstart ) )* open? ;
itemstart = vis item | fn | 'use' utree ';' | 'const' I ':' type '=' expr ';' | 'static' 'mut'? I ':' type '=' expr ';' | 'struct' I gparams? ( '{' sfields? '}' | '(' tfields? ')' ';' | ';' ) | 'enum' I gparams? '{' ( variant ( ',' variant )* ','? )? '}' | 'impl' gparams? type ( 'for' type )? where '{' item* '}' ;
closed = ( '~' ':' )? ( block | 'unsafe' block | if | match | 'loop' block | 'while' hexpr block | 'for' pattern 'in' hexpr block ) | path '!' '{' soup '}' ;
open = expr ;
if = 'if' hexpr block ( 'else' ( if | block ) )? ;
hexpr = 'let' pattern '=' hunit ( hbin hunit )* | hunit ( hbin hunit | '&&' 'let' pattern '=' hunit )* ;
hunit = pre* hprim post* ;
hbin = binop | '..' | '..=' ;
match = 'match' hunit ( hbin hunit )* '{' ( arm )* '}' ;
arm = attr* '|'? pattern ( 'if' expr )? '=>' ( expr ','? ) ;
pattern = punit ( '|' punit )* ;
punit = ( 'ref' | 'mut' )* ( path ( '(' pats? ')' | '{' ( pfield ( ',' pfield )* ','? )? '}' | '@' punit | '!' '(' soup ')' )? | '-'? N | S ) ( ( '..' | '..=' | '...' ) ( '-'? N | S | path )? )? | '..' | ( '..=' ) ( N | S ) | '&' 'mut'? punit | '&&' punit | '(' pats? ')' | '[' pats? ']' ;
pats = pattern ( ',' pattern )* ','? ;
pfield = ( 'ref' | 'mut' )* I ( ':' pattern )? | '..' | N ':' pattern ;
expr = ( rng | unit ( bin unit | 'as' tunit )* rtail? ) ;
bin = binop ;
rtail = ( '..' | '..=' ) ( unit ( binop unit )* )? ;
rng = ( '..' | '..=' ) ( unit ( binop unit )* )? ;
unit = pre* prim post* | jump ;
jump = ( 'return' | 'break' '~'? ) expr? | 'continue' '~'? ;
pre = '-' | '!' | '*' | '&' 'mut'? | '&&' 'mut'? ;
prim = hprim0 | spath ( '{' ( fieldinit ( ',' fieldinit )* ','? )? ( '..' expr )? '}' )? ;
hprim = hprim0 | spath ;
spath = '::'? seg ( '::' ( seg | gargs ) )* ( '!' ( '(' soup ')' | '[' soup ']' | '{' soup '}' ) )? | '<' type ( 'as' path )? '>' '::' path ;
seg = I | 'self' | 'super' | 'crate' ;
fieldinit = ( I | N ) ( ':' expr )? | '..' expr ;
hprim0 = N | S | '(' ( expr ( ',' expr )* ','? )? ')' | '[' ( expr ( ';' expr | ( ',' expr )* ','? ) )? ']' | closed | 'async' 'move'? block | 'const' block | ( 'async' | 'move' )* ( '||' | '|' ( pattern1 ( ',' pattern1 )* ','? )? '|' ) ( '->' type block | expr ) ;
pattern1 = punit ( ':' type )? ;
post = '.' ( I ( '::' gargs )? | N | 'await' ) | '(' ( expr ( ',' expr )* ','? )? ')' | '[' expr ']' | '?' ;
binop = '+' | '-' | '*' | '/' | '%' | '<' | '>' '>'* '='? | '<=' | '>=' | '==' | '!=' | '&&' | '||' | '&' | '|' | '^' | '<<' | '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '<<=' | '>>=' | '&=' | '|=' | '^=' ;
""",
)

JSON = Language(
    strings=r"\"(?:[^\"\\\x00-\x1f]|\\[\"\\/bfnrt]|\\u[0-9a-fA-F]{4})*\"", comments=r"(?!)", keywords="true false null", operators=r"(?!)", names=r"[A-Za-z_$][\w$]*",
    numbers=r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.])",
    grammar=r"""
file = value ;
value = S | N | 'true' | 'false' | 'null' | '{' ( pair ( ',' pair )* )? '}' | '[' ( value ( ',' value )* )? ']' ;
pair = S ':' value ;
""",
)

TOML = Language(
    strings=r"\"\"\"(?:[^\"\\]|\\[\s\S]|\"{1,2}(?!\"))*\"{3,5}|'''[\s\S]*?'{3,5}|" + DQ.replace(r"|\\\n", "") + r"|'[^'\n]*'", comments=r"#[^\n]*", keywords="true false", operators=r"(?!)", names=r"[A-Za-z0-9_\-]*[A-Za-z_][A-Za-z0-9_\-]*(?![^\s=\].,#}])", lines="all",
    numbers=r"[+-]?(?:\d{4}-\d\d-\d\d(?:[Tt ]\d\d:\d\d(?::\d\d)?(?:\.\d+)?(?:[Zz]|[+-]\d\d:\d\d)?)?|\d\d:\d\d:\d\d(?:\.\d+)?|0[xob][0-9a-fA-F_]+|\d[\d_]*(?:\.\d[\d_]*)?(?:[eE][+-]?\d+)?|inf|nan)(?![\w-])",
    grammar=r"""
file = line ( NL line )* ;
line = ( '[' keys ']' | '[' '[' keys ']' ']' | keys '=' value )? ;
keys = key ( '.' key )* ;
key = I | S | N | 'true' | 'false' ;
value = S | N | 'true' | 'false' | '[' NL* ( value NL* ( ',' NL* value NL* )* ','? NL* )? ']' | '{' ( keys '=' value ( ',' keys '=' value )* )? '}' ;
""",
)

BASH = Language(  # read by tarnwork.llm.shell, which replaces words, strings and expansions
    strings=r"(?!)", comments=r"(?!)", keywords="if then elif else fi for while until do done case in esac function select time",
    operators=r";;&|;;|;&|&&|\|\||<<<|<<-|<<|>>|>&|<&|&>|\|&|\[\[|\]\]|=\(", lines="all", numbers=r"(?!)",
    grammar=r"""
file = sep* ( list )? ;
sep = NL | ';' ;
term = ( ';' | '&' | NL ) NL* ;
list = andor ( term andor )* term? ;
andor = pipe ( ( '&&' | '||' ) NL* pipe )* ;
pipe = 'time'? cmd ( ( '|' | '|&' ) NL* cmd )* ;
redir = N? ( '<' | '>' | '>>' | '<<<' | '>&' | '<&' | '&>' ) ( I | S )+ ;
cmd = simple | compound redir* ;
simple = ( I | S | redir | array | test )+ ( I | S | redir | array | test | kw )* ( '(' ')' NL* compound redir* )? ;
array = '=(' ( I | kw | '{' | '}' | NL )* ')' ;
test = '[[' cond ']]' ;
cond = NL* unit ( ( '&&' | '||' ) NL* unit )* ;
unit = I+ ( ( '<' | '>' ) I )? NL* | I* '(' cond ')' NL* ;
compound = '{' NL* list '}' | '(' NL* list ')' | 'if' NL* list 'then' NL* list ( 'elif' NL* list 'then' NL* list )* ( 'else' NL* list )? 'fi'
  | 'for' ( I | kw | '(' ) ( NL* 'in' ( I | S | kw )* )? sep+ ( 'do' NL* list 'done' | '{' NL* list '}' ) | ( 'while' | 'until' ) NL* list 'do' NL* list 'done' | 'select' I 'in' ( I | S )* sep+ 'do' NL* list 'done'
  | 'case' ( I | S | kw )+ NL* 'in' NL* ( '('? pat ( '|' pat )* ')' NL* list? ( ( ';;' | ';;&' | ';&' ) NL* ) )* ( '('? pat ( '|' pat )* ')' NL* list )? 'esac'
  | 'function' I ( '(' ')' )? NL* compound ;
pat = ( I | S | kw )+ ;
kw = 'if' | 'then' | 'elif' | 'else' | 'fi' | 'for' | 'while' | 'until' | 'do' | 'done' | 'case' | 'in' | 'esac' | 'function' | 'select' | 'time' ;
""",
)

SQL = Language(
    strings=r"\$(?P<t>\w*)\$[\s\S]*?\$(?P=t)\$|'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`[^`]*`", comments=r"--[^\n]*|" + BLOCK_COMMENT, operators=r"<>|<=|>=|!=|\|\||::|->>|->|:=|<<|>>",
    keywords="select from where group order by having limit offset join left right full inner outer cross on using as insert into values update set delete create table index view or replace unique if not exists drop alter add column primary key foreign references default null constraint check and in like ilike between is case when then else end union all distinct except intersect with asc desc begin commit rollback cast over partition grant revoke analyze explain vacuum pragma use call comment truncate declare execute do copy merge show describe lock start savepoint release reindex attach detach refresh",
    names=r"[A-Za-z_@#:\x80-\U0010ffff][\w$@#]*|\[[A-Za-z_]\w*\]",
    grammar=r"""
file = ( stmt? ';' )* stmt? ;
stmt = query | insert | 'update' name alias? 'set' asg ( ',' asg )* ( 'from' tables )? ( 'where' expr )? returning | 'delete' 'from' name alias? ( 'using' tables )? ( 'where' expr )? returning | create | 'drop' ( 'table' | 'index' | 'view' | I ) ( 'if' 'exists' )? names I?
  | 'alter' ( 'table' | I ) ( 'if' 'exists' )? name alters | ( 'begin' | 'commit' | 'rollback' ) I? | 'set' I I? ( '=' | I )? ( expr | 'on' )? ( ',' expr )* | other ;
soft = 'grant' | 'revoke' | 'analyze' | 'explain' | 'vacuum' | 'pragma' | 'use' | 'call' | 'comment' | 'truncate' | 'declare' | 'execute' | 'do' | 'copy' | 'merge' | 'show' | 'describe' | 'lock' | 'start' | 'savepoint' | 'release' | 'reindex' | 'attach' | 'detach' | 'refresh' ;
other = soft words ;
words = word* ;
word = I | N | S | soft | '.' | ',' | '=' | '*' | kw | '(' ( word | ';' )* ')' ;
kw = 'on' | 'by' | 'like' | 'check' | 'references' | 'primary' | 'key' | 'limit' | 'having' | 'group' | 'order' | 'where' | 'join' | 'add' | 'drop' | 'replace' | 'unique' | 'constraint' | 'foreign' | 'create' | 'all' | 'table' | 'from' | 'select' | 'insert' | 'update' | 'delete' | 'in' | 'with' | 'as' | 'is' | 'null' | 'not' | 'default' | 'set' | 'if' | 'exists' | 'or' | 'and' | 'index' | 'column' | 'view' | 'into' | 'values' | 'using' | 'end' | 'begin' | 'case' | 'when' | 'then' | 'else' | 'for' ;
names = name ( ',' name )* ;
id = I | S | soft | 'key' | 'index' | 'offset' | 'replace' | 'check' | 'begin' | 'end' | 'column' | 'partition' | 'view' | 'over' | 'left' | 'right' | 'default' | 'cast' | 'values' | 'set' | 'add' | 'if' ;
name = ( I | S | soft | 'key' | 'index' | 'column' | 'offset' | 'end' | 'begin' ) ( '.' id )* ;
alias = 'as' id | I | S ;
returning = ( I items )? ;
insert = 'insert' ( 'or' ( 'replace' | I ) )? 'into' name alias? ( '(' cols ')' )? ( 'values' row ( ',' row )* | query | 'default' 'values' ) ( 'on' words )? returning ;
cols = id ( ',' id )* ;
row = '(' ( expr | 'default' ) ( ',' ( expr | 'default' ) )* ')' ;
asg = ( name | '(' cols ')' ) '=' ( expr | 'default' ) ;
query = ( 'with' I? cte ( ',' cte )* )? ( qterm more | insert ) ;
more = ( ( 'union' | 'except' | 'intersect' ) ( 'all' | 'distinct' )? qterm )* ( 'order' 'by' orders )? ( 'limit' expr ( ( 'offset' | ',' ) expr )? | 'offset' expr )* ;
inner = 'with' I? cte ( ',' cte )* ( qterm more | insert ) | ( select | 'values' row ( ',' row )* ) more | exprs more ;
cte = id ( '(' cols ')' )? 'as' ( 'not'? I )? '(' stmt ')' ;
qterm = select | '(' query ')' | 'values' row ( ',' row )* ;
select = 'select' ( 'all' | 'distinct' ( 'on' '(' exprs ')' )? )? items ( 'into' name )? ( 'from' tables )? ( 'where' expr )? ( 'group' 'by' exprs )? ( 'having' expr )? ;
items = item ( ',' item )* ;
item = '*' | expr alias? ;
tables = tref ( ',' tref | jkind 'join' tref1 ( 'on' expr | 'using' '(' cols ')' )? )* ;
jkind = I? ( 'left' | 'right' | 'full' | 'inner' | 'cross' )? 'outer'? ;
tref = tref1 ;
tref1 = ( name ( '(' exprs? ')' )? | I? '(' query ')' ) talias? ;
talias = 'as'? ( I | S ) ( '(' cols ')' )? ;
orders = ord ( ',' ord )* ;
ord = expr ( 'asc' | 'desc' )? ( I I )? ;
exprs = expr ( ',' expr )* ;
expr = unit ( op unit | 'is' 'not'? ( 'null' | 'distinct' 'from' unit | I ) | 'not'? 'in' ( '(' inner? ')' | unit ) | 'not'? 'between' unit | I unit )* ;
op = '+' | '-' | '*' | '/' | '%' | '<' | '>' | '=' | '<=' | '>=' | '<>' | '!=' | '||' | '->' | '->>' | '&' | '|' | '^' | '~' | 'and' | 'or' | 'not'? ( 'like' | 'ilike' ) ;
unit = ( '-' | '+' | 'not' | '~' | 'distinct' | 'exists' )* prim post* ;
prim = N | S | 'null' | 'default' | name ( '(' ( '*' | 'distinct'? exprs ( 'order' 'by' orders )? )? ')' )? ( S )? | 'case' expr? ( 'when' expr 'then' expr )+ ( 'else' expr )? 'end' | 'cast' '(' expr 'as' type ')' | '(' inner ')' | ( 'replace' | 'left' | 'right' | 'if' | 'values' ) '(' exprs ')' | '?' | '$' N ;
post = '::' type | 'over' ( id | '(' ( 'partition' 'by' exprs )? ( 'order' 'by' orders )? words ')' ) | '[' expr ( ':' expr )? ']' | '.' '*' ;
type = I I? I? I? ( '(' N ( ',' N )? ')' )? ( 'with' I I | I I I )? ( '[' ']' )* ;
create = 'create' ( 'or' 'replace' )? I? ( table | 'unique'? 'index' I? ( 'if' 'not' 'exists' )? name? 'on' name ( 'using' I )? '(' orders ')' ( 'where' expr )? words | 'view' ( 'if' 'not' 'exists' )? name ( '(' cols ')' )? 'as' query | I words ) | 'create' ( 'or' 'replace' )? I words ;
table = 'table' ( 'if' 'not' 'exists' )? name ( '(' cdef ( ',' cdef )* ')' topts | 'as' query ) ;
topts = ( I | '=' | N | S | 'with' | 'partition' | 'by' | 'default' | 'on' | '(' words ')' )* ;
cdef = 'constraint' id tcons | tcons | id type? ccons* ;
tcons = ( 'primary' 'key' | 'unique' 'key'? | 'foreign' 'key' | 'index' I? | 'key' I? ) I? '(' orders ')' ( 'references' refs )? | 'check' '(' expr ')' ;
ccons = 'not' 'null' | 'null' | 'primary' 'key' ( 'asc' | 'desc' )? | 'unique' | 'default' cval | 'check' '(' expr ')' | 'references' refs | 'constraint' id | I ( 'by' 'default' )? ( 'as' ( I | '(' expr ')' ) )? ;
cval = '-'? prim post* ;
refs = name ( '(' cols ')' )? ( 'on' ( 'delete' | 'update' ) ( I I? | 'set' ( 'null' | 'default' ) ) )* ;
alters = alt ( ',' alt )* ;
alt = 'add' 'column'? ( 'if' 'not' 'exists' )? cdef | 'drop' ( 'column' | 'constraint' )? ( 'if' 'exists' )? id I? | 'alter' 'column'? id words | I words | 'with' I S ;
""",
)

YAML = Language(
    strings=r"(?!)", comments=r"(?!)", keywords="", operators=r"(?!)", lines="yaml",
    grammar=r"""
file = doc ( 'DOC' doc )* ;
doc = node? ;
node = map | seqs | VALUE | flow ;
map = entry+ ;
entry = 'KEY' ( value? | 'IN' node 'OUT' | seqs ) ;
value = VALUE | flow ;
seqs = ditem+ ;
ditem = 'DASH' ( value? | 'IN' node 'OUT' ) ;
flow = '[' ( fnode ( ',' fnode )* ','? )? ']' | '{' ( fpair ( ',' fpair )* ','? )? '}' ;
fnode = value ( ':' value? )? ;
fpair = value ( ':' value? )? ;
""",
)

LANGUAGES = {
    "python": PYTHON, "javascript": JAVASCRIPT, "typescript": TYPESCRIPT, "go": GO, "java": JAVA, "c": C, "rust": RUST,
    "json": JSON, "toml": TOML, "bash": BASH, "sql": SQL, "yaml": YAML,
}
