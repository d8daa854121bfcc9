"""Parsing-expression grammars of nine languages, over the tokens of ``lexers``.

They tell valid from invalid syntax; they build no tree, so operators of all
ranks are one repetition. Names that cannot be resolved are no matter of syntax.
"""

from __future__ import annotations

from functools import lru_cache

from codelode.llm.lexers import JAVA_SOFT, JS_RESERVED, JS_SOFT
from codelode.llm.peg import Grammar


def _any(words) -> str:
    return " / ".join(f"'{w}'" for w in sorted(words))


JSON = """
value <- '{' (pair (',' pair)*)? '}' / '[' (value (',' value)*)? ']' / STRING / NUMBER / 'true' / 'false' / 'null'
pair <- STRING ':' value
"""

XML = """
document <- DOCTYPE? element
element <- EMPTY / OPEN (element / TEXT)* CLOSE
"""

TOML = """
document <- (line? NL)*
line <- '[[' key ']]' / '[' key ']' / key '=' value
key <- KEY ('.' KEY)*
value <- VALUE / '[' (value (',' value)* ','?)? ']' / '{' (key '=' value (',' key '=' value)*)? '}'
"""

YAML = """
stream <- (document / '---')*
document <- INDENT block DEDENT
block <- map / sequence / item
map <- (KEY PROP* (INDENT block DEDENT / '-' &INDENT INDENT block DEDENT dash* / dash+ / flow)? / '?' (INDENT block DEDENT)? )+
sequence <- dash+
dash <- '-' PROP* (INDENT block DEDENT / flow)?
item <- PROP* flow?
flow <- VALUE / QUOTED / '[' (entry (',' entry)* ','?)? ']' / '{' (entry (',' entry)* ','?)? '}'
entry <- '?'? PROP* flow? (':' PROP* flow?)?
"""

PYTHON = """
file <- statement*
statement <- compound / simple
simple <- small (';' small)* ';'? NEWLINE
small <- 'pass' / 'break' / 'continue' / ret / raise / imp / del / glob / assert / typealias / assignment / star_exprs
ret <- 'return' star_exprs?
raise <- 'raise' (expr ('from' expr)?)?
glob <- ('global' / 'nonlocal') name (',' name)*
assert <- 'assert' expr (',' expr)?
del <- 'del' deltarget (',' deltarget)* ','? &(NEWLINE / ';')
deltarget <- '(' (deltarget (',' deltarget)* ','?)? ')' !trailer / '[' (deltarget (',' deltarget)* ','?)? ']' !trailer / single
typealias <- 'type' name typeparams? '=' expr
typeparams <- '[' typeparam (',' typeparam)* ','? ']'
typeparam <- name (':' expr)? ('=' expr)? / '*' name ('=' star_expr)? / '**' name ('=' expr)?
imp <- 'import' dotted ('as' name)? (',' dotted ('as' name)?)* / 'from' (('.' / '...')* dotted / ('.' / '...')+) 'import' ('*' / '(' froms ','? ')' / froms)
froms <- name ('as' name)? (',' name ('as' name)?)*
dotted <- name ('.' name)*
name <- NAME / 'match' / 'case' / 'type' / '_'
assignment <- (single / '(' single ')') ':' expr ('=' (yieldex / star_exprs))? / (targets '=')+ (yieldex / star_exprs) !'=' / single augop (yieldex / star_exprs)
augop <- '+=' / '-=' / '*=' / '/=' / '//=' / '%=' / '@=' / '&=' / '|=' / '^=' / '>>=' / '<<=' / '**='
targets <- startarget (',' startarget)* ','?
startarget <- '*' !'*' target / target
target <- single / '(' targets? ')' / '[' targets? ']'
single <- atom (trailer &trailer)* tailtrailer / name !trailer
trailer <- '.' name / '[' slices ']' / '(' args? ')'
tailtrailer <- '.' name !trailer / '[' slices ']' !trailer
compound <- decorated / 'async' (funcdef / withst / forst) / funcdef / classdef / ifst / whilest / forst / tryst / withst / matchst
decorated <- ('@' namedexpr NEWLINE)+ ('async'? funcdef / classdef)
funcdef <- 'def' name typeparams? '(' params? ')' ('->' expr)? ':' block
params <- param (',' param)* (',' '/' (',' param)*)? (',' starparams)? ','? &')' / param (',' param)* ',' '/' (',' param)* (',' starparams)? ','? / starparams ','?
starparams <- '*' (name (':' star_expr)?) (',' kwparam)* (',' '**' kwname)? / '*' (',' kwparam)+ (',' '**' kwname)? / '**' kwname
kwparam <- name (':' expr)? ('=' expr)?
kwname <- name (':' expr)?
param <- name (':' expr)? ('=' expr)?
classdef <- 'class' name typeparams? ('(' args? ')')? ':' block
block <- NEWLINE INDENT statement+ DEDENT / simple
ifst <- 'if' namedexpr ':' block ('elif' namedexpr ':' block)* ('else' ':' block)?
whilest <- 'while' namedexpr ':' block ('else' ':' block)?
forst <- 'for' targets 'in' star_exprs ':' block ('else' ':' block)?
tryst <- 'try' ':' block (('except' '*' expr ('as' name)? ':' block)+ / ('except' (expr ('as' name)?)? ':' block)+) ('else' ':' block)? ('finally' ':' block)? / 'try' ':' block 'finally' ':' block
withst <- 'with' '(' withitem (',' withitem)* ','? ')' ':' block / 'with' withitem (',' withitem)* ':' block
withitem <- expr 'as' startarget &(',' / ')' / ':') / expr
matchst <- 'match' star_named (',' star_named)* ','? ':' NEWLINE INDENT caseblock+ DEDENT
caseblock <- 'case' patterns ('if' namedexpr)? ':' block
patterns <- starpattern (',' starpattern)* ','?
starpattern <- '*' name / pattern
pattern <- closed ('|' closed)* ('as' name)?
closed <- '-'? NUMBER (('+' / '-') NUMBER)? / STRING+ / BYTES+ / 'None' / 'True' / 'False' / classpattern / '(' patterns? ')' / '[' patterns? ']' / '{' mapitems? '}' / dotted
classpattern <- dotted '(' (argpattern (',' argpattern)* ','?)? ')'
argpattern <- name '=' pattern / pattern
mapitems <- mapitem (',' mapitem)* ','?
mapitem <- '**' name / ('-'? NUMBER / STRING+ / BYTES+ / 'None' / 'True' / 'False' / dotted) ':' pattern
star_exprs <- star_expr (',' star_expr)* ','? / yieldex
star_expr <- '*' or_expr / expr
star_named <- '*' or_expr / namedexpr
yieldex <- 'yield' ('from' expr / star_exprs)?
namedexpr <- name ':=' expr / expr !':='
expr <- lambda / disjunction ('if' disjunction 'else' expr)?
lambda <- 'lambda' lparams? ':' expr
lparams <- lparam (',' lparam)* (',' '/' (',' lparam)*)? (',' lstar)? ','? &':' / lstar ','?
lparam <- name ('=' expr)?
lstar <- '*' name (',' lparam)* (',' '**' name)? / '*' (',' lparam)+ (',' '**' name)? / '**' name
disjunction <- inversion (('or' / 'and') inversion)*
inversion <- 'not'* or_expr (compop 'not'* &notless or_expr)*
notless <- !'not' or_expr
compop <- '==' / '!=' / '<=' / '>=' / '<' / '>' / 'not' 'in' / 'in' / 'is' 'not' / 'is'
or_expr <- unary (binop unary)*
binop <- '|' / '^' / '&' / '<<' / '>>' / '+' / '-' / '*' / '//' / '/' / '%' / '@'
unary <- ('+' / '-' / '~')* power
power <- 'await'? atom trailer* ('**' unary)?
atom <- name / 'True' / 'False' / 'None' / STRING+ / BYTES+ / NUMBER / '...' / group / list / dict
group <- '(' (yieldex / star_named (',' star_named)* ','? / namedexpr comp)? ')' / '(' namedexpr comp ')'
list <- '[' namedexpr comp ']' / '[' (star_named (',' star_named)* ','?)? ']'
dict <- '{' expr ':' expr comp '}' / '{' (kv (',' kv)* ','?)? '}' / '{' namedexpr comp '}' / '{' star_named (',' star_named)* ','? '}'
kv <- '**' or_expr / expr ':' expr
comp <- ('async'? 'for' targets 'in' disjunction ('if' condition)*)+
condition <- name ':=' disjunction / disjunction
slices <- slice (',' slice)* ','?
slice <- expr? ':' expr? (':' expr?)? / star_named
args <- namedexpr comp / arg (',' arg)* ','?
arg <- kwarg / '*' expr / posarg
posarg <- namedexpr !'='
kwarg <- name '=' expr / '**' expr
"""

#: Positional arguments may not follow named ones: the argument list in three stretches.
PYTHON = PYTHON.replace(
    "args <- namedexpr comp / arg (',' arg)* ','?\narg <- kwarg / '*' expr / posarg\n",
    "args <- namedexpr comp &')' / plain (',' plain)* (',' named)? ','? / named ','?\nplain <- !kwarg ('*' expr / posarg)\n"
    "named <- (name '=' expr / '*' expr) (',' (name '=' expr / '*' expr))* (',' kwarg)* / kwarg (',' kwarg)*\n",
)

_JS = """
module <- item*
item <- import / export / statement
import <- 'import' STRING attrs? eos / 'import' clause 'from' STRING attrs? eos
attrs <- 'with' object
clause <- defclause (',' (nsclause / named))? / nsclause / named
defclause <- ident
nsclause <- '*' 'as' ident
named <- '{' (spec (',' spec)* ','?)? '}'
spec <- (word / STRING) 'as' (word / STRING) / word / STRING
export <- 'export' 'default' (funcdecl / classdecl / expr eos) / 'export' '*' ('as' (word / STRING))? 'from' STRING attrs? eos / 'export' named ('from' STRING attrs?)? eos / 'export' decl
decl <- funcdecl / classdecl / vardecl eos
statement <- blockst / ifst / forst / whilest / dost / tryst / switchst / funcdecl / classdecl / vardecl eos / ret / throw / jump / label / ';' / exprst
exprst <- !'{' !'function' !'class' expr eos
blockst <- '{' statement* '}'
eos <- ';' / &'}' / &END / LINE
vardecl <- 'const' binding_init (',' binding_init)* / ('let' / 'var') binding (',' binding)*
binding_init <- target typeann? '=' assign
binding <- objpat typeann? '=' assign / arrpat typeann? '=' assign / ident '!'? typeann? ('=' assign)?
target <- ident / objpat / arrpat
objpat <- '{' (prop_pat (',' prop_pat)* ','?)? '}'
prop_pat <- '...' target / propname ':' target ('=' assign)? / ident ('=' assign)?
arrpat <- '[' ','* (elem_pat (','+ elem_pat)* ','*)? ']'
elem_pat <- '...' target / target ('=' assign)?
ifst <- 'if' '(' expr ')' body ('else' body)?
body <- statement
whilest <- 'while' '(' expr ')' body
dost <- 'do' body 'while' '(' expr ')' ';'?
forst <- 'for' 'await'? '(' forhead ')' body
forhead <- ('const' / 'let' / 'var') target typeann? ('of' assign / 'in' expr) &')' / leftside ('of' assign / 'in' expr) &')' / (fordecl / expr)? ';' expr? ';' expr?
fordecl <- ('const' / 'let' / 'var') target typeann? ('=' assign)? (',' target typeann? ('=' assign)?)*
tryst <- 'try' blockst ('catch' ('(' target typeann? ')')? blockst ('finally' blockst)? / 'finally' blockst)
switchst <- 'switch' '(' expr ')' '{' (('case' expr / 'default') ':' statement*)* '}'
ret <- 'return' (eos / expr eos)
throw <- 'throw' !LINE expr eos
jump <- ('break' / 'continue') (!LINE ident)? eos / 'debugger' eos
label <- ident ':' statement
funcdecl <- 'async'? 'function' '*'? ident? typeparams? params rettype? funcbody
funcbody <- blockst
params <- '(' (param (',' param)* ','?)? ')'
param <- decorator* '...' target typeann? / decorator* target typeann? ('=' assign)?
classdecl <- decorator* 'class' (!'extends' !'implements' ident)? typeparams? ('extends' leftside typeargs?)? implements? '{' member* '}'
decorator <- '@' postfix
member <- ';' / 'static' blockst / decorator* modifier* method / decorator* modifier* field
modifier <- 'static' &memberstart
memberstart <- propname / '*' / 'async' / 'get' / 'set' / '['
method <- accessor params rettype? funcbody / ('async' !LINE)? '*'? propname typeparams? params rettype? funcbody
accessor <- ('get' / 'set') propname
field <- propname typeann? ('=' assign)? eos
propname <- word / STRING / NUMBER / PRIVATE / '[' assign ']'
expr <- assign (',' assign)*
assign <- arrow / yieldex / leftpat '=' assign / cond (assignop assign)?
assignop <- '=' / '+=' / '-=' / '*=' / '/=' / '%=' / '**=' / '<<=' / '>' '>' '>=' / '>' '>=' / '&=' / '|=' / '^=' / '&&=' / '||=' / '??='
leftpat <- (objpat / arrpat) &'='
yieldex <- 'yield' (!LINE '*'? assign)?
arrow <- ('async' !LINE)? arrowhead '=>' (funcbody / !'{' assign)
arrowhead <- ident / typeparams? params rettype?
cond <- binary ('?' assign ':' assign / '?' cond_plain ':' assign)?
cond_plain <- binary
binary <- unary (binop unary)*
binop <- '||' / '&&' / '??' / '|' / '^' / '&' / '===' / '!==' / '==' / '!=' / '<=' / '>=' / '<<' / '>' '>' '>' / '>' '>' / '<' / '>' / 'instanceof' / 'in' / '+' / '-' / '**' / '*' / '/' / '%'
unary <- ('!' / '~' / '+' / '-' / 'typeof' / 'void' / 'delete' / 'await') unary / ('++' / '--') unary / postfix (!LINE ('++' / '--'))?
postfix <- leftside
leftside <- primary suffix*
suffix <- '.' (word / PRIVATE) / '?.' (word / PRIVATE / '[' expr ']' / args / template) / '[' expr ']' / args / template
args <- '(' (arg (',' arg)* ','?)? ')'
arg <- '...'? assign
template <- TPL / TPL_HEAD expr (TPL_MID expr)* TPL_TAIL
primary <- 'this' / 'super' / 'null' / 'true' / 'false' / NUMBER / STRING / REGEX / template / 'new' newtarget / 'import' (args / '.' word) / funcdecl / classdecl / object / array / '(' expr ')' / PRIVATE &'in' / ident
newtarget <- '.' word / 'new' newtarget / newhead typeargs? args?
newhead <- ('this' / ident / '(' expr ')' / classdecl / funcdecl) ('.' (word / PRIVATE) / '[' expr ']')*
object <- '{' (property (',' property)* ','?)? '}'
property <- '...' assign / accessor params rettype? funcbody / ('async' !LINE)? '*'? propname typeparams? params rettype? funcbody / propname ':' assign / ident ('=' assign)?
array <- '[' ','* (arg (','+ arg)* ','*)? ']'
ident <- NAME / @SOFT@
word <- ident / @RESERVED@
typeann <- '#no'
rettype <- '#no'
typeparams <- '#no'
typeargs <- '#no'
implements <- '#no'
""".replace("@SOFT@", _any(JS_SOFT)).replace("@RESERVED@", _any(JS_RESERVED))

#: Rules that TypeScript has in another form or besides.
_TS = """
import <- 'import' STRING attrs? eos / 'import' 'type'? clause 'from' STRING attrs? eos / 'import' ident '=' ('require' '(' STRING ')' / qualified) eos
spec <- 'type'? (word / STRING) 'as' (word / STRING) / 'type' word / word / STRING
export <- 'export' '=' expr eos / 'export' 'as' 'namespace' ident eos / 'export' 'default' (interface / 'abstract'? classdecl / funcdecl / expr eos) / 'export' 'type'? '*' ('as' (word / STRING))? 'from' STRING attrs? eos / 'export' 'type'? named ('from' STRING attrs?)? eos / decorator* 'export' decl
decl <- declare / interface / enum / namespace / typealias / 'abstract' !LINE classdecl / funcdecl / classdecl / vardecl eos
declare <- 'declare' !LINE (ambient / 'global' '{' ambientitem* '}' / decl / ('const' / 'let' / 'var') ident typeann? (',' ident typeann?)* eos)
statement <- blockst / ifst / forst / whilest / dost / tryst / switchst / declare / interface / enum / namespace / typealias / 'abstract' !LINE classdecl / funcdecl / classdecl / vardecl eos / ret / throw / jump / label / ';' / exprst
ambient <- ('namespace' / 'module') !LINE (STRING / qualified) ('{' ambientitem* '}' / eos)
ambientitem <- 'export'? ('const' / 'let' / 'var') ident typeann? (',' ident typeann?)* eos / item
interface <- 'interface' !LINE ident typeparams? ('extends' typeref (',' typeref)*)? objtype
enum <- 'const'? 'enum' ident '{' (enumitem (',' enumitem)* ','?)? '}'
enumitem <- propname ('=' assign)?
namespace <- ('namespace' / 'module') !LINE (STRING / qualified) ('{' item* '}' / eos)
typealias <- 'type' !LINE ident typeparams? '=' type eos
qualified <- ident ('.' word)*
typeann <- ':' type
rettype <- ':' (predicate / type)
predicate <- 'asserts'? (ident / 'this') 'is' type / 'asserts' (ident / 'this') !LINE
typeparams <- '<' typeparam (',' typeparam)* ','? '>'
typeparam <- ('const' / 'in' / 'out')* ident ('extends' type)? ('=' type)?
typeargs <- '<' type (',' type)* ','? '>'
implements <- 'implements' typeref (',' typeref)*
typeref <- qualified typeargs?
type <- functype / 'asserts'? 'this' 'is' type / condtype
functype <- 'abstract'? 'new'? typeparams? params_t '=>' (predicate / type)
params_t <- '(' (param_t (',' param_t)* ','?)? ')'
param_t <- '...' target typeann? / 'this' typeann / target '?'? typeann?
condtype <- uniontype ('extends' !LINE uniontype '?' type ':' type)?
uniontype <- '|'? intertype ('|' intertype)*
intertype <- '&'? opertype ('&' opertype)*
opertype <- ('keyof' / 'unique' / 'readonly' / 'infer') opertype / arraytype
arraytype <- primtype (!LINE '[' type? ']')*
primtype <- '(' type ')' / mapped / objtype / tuple / 'typeof' ('import' args / qualified) typeargs? / 'import' '(' STRING ')' ('.' word)* typeargs? / '-'? NUMBER / STRING / 'true' / 'false' / 'null' / 'void' / 'this' / TPL / TPL_HEAD type (TPL_MID type)* TPL_TAIL / typeref
tuple <- '[' (tupleitem (',' tupleitem)* ','?)? ']'
tupleitem <- '...'? (word '?'? ':' type / type '?'?)
mapped <- '{' (('+' / '-')? 'readonly')? '[' ident 'in' type ('as' type)? ']' (('+' / '-')? '?')? typeann? (';' / ',')? '}'
objtype <- '{' (typemember (typesep typemember)* typesep?)? '}'
typesep <- ';' / ',' / LINE
typemember <- 'new' typeparams? params_t rettype? / typeparams? params_t rettype? / ('readonly' / '+' / '-')* '[' ident ':' type ']' typeann? / ('get' / 'set') propname params_t rettype? / ('readonly' &propname)? propname '?'? (typeparams? params_t rettype? / typeann?)
funcdecl <- 'async'? 'function' '*'? ident? typeparams? params rettype? (funcbody / eos)
param <- decorator* pmod* '...' target typeann? / 'this' typeann / decorator* pmod* target '?'? typeann? ('=' assign)?
pmod <- ('public' / 'private' / 'protected' / 'readonly' / 'override') &(ident / '{' / '[')
modifier <- ('static' / 'public' / 'private' / 'protected' / 'readonly' / 'abstract' / 'override' / 'declare' / 'accessor') !LINE &memberstart
memberstart <- propname / '*' / 'async' / 'get' / 'set' / '[' / 'readonly'
member <- ';' / 'static' blockst / decorator* modifier* '[' ident ':' type ']' typeann eos / decorator* modifier* method / decorator* modifier* field
method <- accessor params rettype? (funcbody / eos) / ('async' !LINE)? '*'? propname '?'? typeparams? params rettype? (funcbody / eos)
field <- propname ('?' / '!')? typeann? ('=' assign)? eos
binary <- unary castas* (binop unary castas*)*
castas <- !LINE ('as' / 'satisfies') ('const' / type)
suffix <- '.' (word / PRIVATE) / '?.' (word / PRIVATE / '[' expr ']' / typeargs? args / template) / '[' expr ']' / args / template / !LINE '!' / typeargs &('(' / TPL / TPL_HEAD) / typeargs args
unary <- ('!' / '~' / '+' / '-' / 'typeof' / 'void' / 'delete' / 'await') unary / ('++' / '--') unary / '<' type '>' unary / postfix (!LINE ('++' / '--'))?
cond <- binary ('?' assign ':' assign / '?' cond_plain ':' assign)?
forhead <- ('const' / 'let' / 'var') target typeann? ('of' assign / 'in' expr) &')' / leftside ('of' assign / 'in' expr) &')' / (fordecl / expr)? ';' expr? ';' expr?
"""

GO = """
file <- 'package' NAME ';' (import ';')* (toplevel ';')* (toplevel ';'?)?
import <- 'import' (importspec / '(' (importspec ';')* importspec? ')')
importspec <- ('.' / NAME)? STRING
toplevel <- funcdecl / declaration
declaration <- 'const' (constspec / '(' (constspec ';')* constspec? ')') / 'var' (varspec / '(' (varspec ';')* varspec? ')') / 'type' (typespec / '(' (typespec ';')* typespec? ')')
constspec <- names (type? '=' exprs)?
varspec <- names (type ('=' exprs)? / '=' exprs)
typespec <- NAME typeparams '='? type / NAME '='? type
typeparams <- '[' tparam (',' tparam)* ','? ']'
tparam <- names constraint
constraint <- '~'? type ('|' '~'? type)*
names <- NAME (',' NAME)*
funcdecl <- 'func' receiver NAME signature block? / 'func' NAME typeparams? signature block?
receiver <- '(' NAME? '*'? NAME ('[' names ','? ']')? ','? ')'
signature <- params result?
result <- params / type
params <- '(' (paramdecl (',' paramdecl)* ','?)? ')'
paramdecl <- NAME '...'? type / '...'? type
type <- '(' type ')' / '*' type / '[' ']' type / '[' '...' ']' type / '[' expr ']' type / 'map' '[' type ']' type / 'chan' '<-'? type / '<-' 'chan' type / 'func' signature / struct / interface / NAME ('.' NAME)? ('[' type (',' type)* ','? ']')?
struct <- 'struct' '{' (field ';')* field? '}'
field <- (names type / '*'? NAME ('.' NAME)? ('[' type (',' type)* ']')?) STRING?
interface <- 'interface' '{' (method ';')* method? '}'
method <- NAME signature / constraint
block <- '{' stmts '}'
stmts <- (stmt? ';')* stmt?
stmt <- declaration / labeled / 'go' expr / 'defer' expr / 'return' exprs? / ('break' / 'continue' / 'goto') NAME? / 'fallthrough' / block / ifst / switchst / selectst / forst / simple
labeled <- NAME ':' !'=' stmt?
simple <- exprs (('=' / '+=' / '-=' / '*=' / '/=' / '%=' / '&=' / '|=' / '^=' / '<<=' / '>>=' / '&^=') exprs / ':=' ('range' expr / exprs) / '++' / '--' / '<-' expr)?
ifst <- 'if' (simple_h? ';')? expr_h block ('else' (ifst / block))?
switchst <- 'switch' (simple_h? ';')? guard? '{' case* '}'
guard <- (NAME ':=')? primary_h '.' '(' 'type' ')' / simple_h
case <- ('case' caseexprs / 'default') ':' stmts
caseexprs <- (expr / type) (',' (expr / type))*
selectst <- 'select' '{' (('case' simple / 'default') ':' stmts)* '}'
forst <- 'for' (simple_h? ';' expr_h? ';' simple_h? / (exprs_h ('=' / ':='))? 'range' expr_h / expr_h)? block
simple_h <- exprs_h (('=' / '+=' / '-=' / '*=' / '/=' / '%=' / '&=' / '|=' / '^=' / '<<=' / '>>=' / '&^=') exprs_h / ':=' exprs_h / '++' / '--' / '<-' expr_h)?
exprs_h <- expr_h (',' expr_h)*
expr_h <- unary_h (binop unary_h)*
unary_h <- ('+' / '-' / '!' / '^' / '*' / '&' / '<-') unary_h / primary_h
primary_h <- operand_h suffix*
operand_h <- NUMBER / STRING / CHAR / '(' (expr / type) ')' / 'func' signature block / littype literal / conversion / NAME
exprs <- expr (',' expr)*
expr <- unary (binop unary)*
binop <- '||' / '&&' / '==' / '!=' / '<=' / '>=' / '<' / '>' / '+' / '-' / '|' / '^' / '*' / '/' / '%' / '<<' / '>>' / '&^' / '&'
unary <- ('+' / '-' / '!' / '^' / '*' / '&' / '<-') unary / primary
primary <- operand suffix*
operand <- NUMBER / STRING / CHAR / '(' (expr / type) ')' / 'func' signature block / littype literal / NAME ('.' NAME)? ('[' type (',' type)* ']')? literal / conversion / NAME
littype <- '[' ']' type / '[' '...' ']' type / '[' expr ']' type / 'map' '[' type ']' type / struct
conversion <- ('[' ']' type / '[' expr ']' type / 'map' '[' type ']' type / 'chan' type / '<-' 'chan' type / 'interface' '{' '}' / struct / 'func' signature) &('(' / ')' / ',')
suffix <- '.' NAME / '.' '(' ('type' / type) ')' / '[' expr? ':' expr? (':' expr)? ']' / '[' (expr / type) (',' (expr / type))* ','? ']' / '(' (arg (',' arg)* '...'? ','?)? ')'
arg <- expr / type
literal <- '{' (element (',' element)* ','?)? '}'
element <- (value ':')? value
value <- literal / expr
"""

JAVA = """
file <- modular / (annotation* 'package' dotted ';')? import* (typedecl / ';')*
modular <- annotation* 'open'? 'module' dotted '{' directive* '}'
directive <- (NAME / soft) (NAME / soft / '.' / ',' / 'with' / 'transitive')* ';'
import <- 'import' 'static'? name ('.' name)* ('.' '*')? ';' / ';'
dotted <- name ('.' name)*
name <- NAME / soft
soft <- @SOFT@
typedecl <- modifiers (class / interface / enum / record / annotype)
modifiers <- (annotation / 'public' / 'protected' / 'private' / 'static' / 'abstract' / 'final' / 'native' / 'synchronized' / 'transient' / 'volatile' / 'strictfp' / 'sealed' / 'non' '-' 'sealed' / 'default' !':' !'->')*
annotation <- '@' !'interface' dotted ('(' (annopair (',' annopair)* / annovalue)? ')')?
annopair <- name '=' annovalue
annovalue <- annotation / '{' (annovalue (',' annovalue)*)? ','? '}' / ternary
class <- 'class' name typeparams? ('extends' type)? ('implements' types)? ('permits' types)? classbody
interface <- 'interface' name typeparams? ('extends' types)? ('permits' types)? classbody
enum <- 'enum' name ('implements' types)? '{' (enumconst (',' enumconst)*)? ','? (';' member*)? '}'
enumconst <- annotation* name args? classbody?
record <- 'record' name typeparams? '(' (component (',' component)*)? ')' ('implements' types)? classbody
component <- annotation* type '...'? name
annotype <- '@' 'interface' name '{' (annomember / member)* '}'
annomember <- modifiers type name '(' ')' dims 'default' annovalue ';'
classbody <- '{' member* '}'
member <- ';' / 'static'? block / typedecl / modifiers name block / modifiers typeparams? name formals throws? block / modifiers typeparams? ('void' / type) name formals dims throws? (block / ';') / modifiers type declarators ';'
throws <- 'throws' types
declarators <- declarator (',' declarator)*
declarator <- name dims ('=' init)?
init <- '{' (init (',' init)*)? ','? '}' / expr
dims <- (annotation* '[' ']')*
formals <- '(' (formal (',' formal)*)? ')'
formal <- ('final' / annotation)* type annotation* ('...' )? ('this' / name ('.' 'this')?) dims
typeparams <- '<' typeparam (',' typeparam)* '>'
typeparam <- annotation* name ('extends' type ('&' type)*)?
types <- type (',' type)*
type <- annotation* (primitive / classtype) dims
primitive <- 'boolean' / 'byte' / 'short' / 'int' / 'long' / 'char' / 'float' / 'double'
classtype <- name typeargs? ('.' annotation* name typeargs?)*
typeargs <- '<' (typearg (',' typearg)*)? '>'
typearg <- annotation* '?' (('extends' / 'super') type)? / type
block <- '{' blockstmt* '}'
blockstmt <- localclass / localvar ';' / statement
localclass <- ('final' / 'abstract' / 'static' / 'sealed' / annotation)* (class / interface / enum / record)
localvar <- ('final' / annotation)* type declarators
statement <- block / ';' / 'if' '(' expr ')' statement ('else' statement)? / 'while' '(' expr ')' statement / 'do' statement 'while' '(' expr ')' ';' / forst / tryst / switchex / 'return' expr? ';' / 'throw' expr ';' / 'break' name? ';' / 'continue' name? ';' / 'yield' !'=' !'.' !'++' !'--' expr ';' / 'assert' expr (':' expr)? ';' / 'synchronized' '(' expr ')' block / name ':' statement / exprstmt ';'
exprstmt <- assignment / ('++' / '--') unary / callish
callish <- primary suffix* callend
callend <- &';' / &')' / &',' / &'}'
assignment <- ternary assignop expr
assignop <- '=' / '+=' / '-=' / '*=' / '/=' / '%=' / '&=' / '|=' / '^=' / '<<=' / '>' '>' '>=' / '>' '>='
forst <- 'for' '(' ('final' / annotation)* type name ':' expr ')' statement / 'for' '(' (localvar / exprs)? ';' expr? ';' exprs? ')' statement
exprs <- expr (',' expr)*
tryst <- 'try' '(' resource (';' resource)* ';'? ')' block catch* ('finally' block)? / 'try' block (catch+ ('finally' block)? / 'finally' block)
resource <- ('final' / annotation)* type name '=' expr / primary suffix*
catch <- 'catch' '(' ('final' / annotation)* type ('|' type)* name ')' block
switchex <- 'switch' '(' expr ')' '{' (switchrule+ / switchgroup*) '}'
switchrule <- switchlabel '->' (block / 'throw' expr ';' / expr ';')
switchgroup <- switchlabel ':' blockstmt*
switchlabel <- 'case' caseitem (',' caseitem)* ('when' expr)? / 'default'
caseitem <- 'default' / pattern / ternary
pattern <- ('final' / annotation)* type '(' (pattern (',' pattern)*)? ')' / ('final' / annotation)* type name
expr <- lambda / ternary (assignop expr)?
lambda <- (name / '(' (name (',' name)*)? ')' / formals) '->' (block / expr)
ternary <- binary ('?' expr ':' (lambda / ternary))?
binary <- unary (binop unary / 'instanceof' (pattern / 'final'? type))*
binop <- '||' / '&&' / '|' / '^' / '&' / '==' / '!=' / '<=' / '>=' / '<<' / '>' '>' '>' / '>' '>' / '<' / '>' / '+' / '-' / '*' / '/' / '%'
unary <- ('+' / '-' / '!' / '~' / '++' / '--') unary / cast / primary suffix* ('++' / '--')?
cast <- '(' primitive dims ')' unary / '(' type ('&' type)* ')' (lambda / !'+' !'-' !'++' !'--' unary)
primary <- NUMBER / STRING / CHAR / 'true' / 'false' / 'null' / 'this' args? / 'super' (args / &'.' / &'::') / '(' expr ')' / 'new' creator / switchex / methodref / primitive dims '.' 'class' / 'void' '.' 'class' / name args? / typeargs name args
methodref <- type '::' typeargs? (name / 'new')
creator <- typeargs? annotation* (primitive / classtype) (('[' expr ']')+ dims / ('[' ']')+ init / args classbody?)
suffix <- '.' 'new' typeargs? name typeargs? args classbody? / '.' typeargs? (name / 'super') args? / '.' 'this' / '.' 'class' / '[' expr ']' / '::' typeargs? (name / 'new') / ('[' ']')+ '.' 'class'
args <- '(' (expr (',' expr)*)? ')'
""".replace("@SOFT@", _any(JAVA_SOFT))

TEXTS = {
    "json": JSON, "xml": XML, "toml": TOML, "yaml": YAML, "python": PYTHON,
    "javascript": _JS, "typescript": _JS + _TS, "go": GO, "java": JAVA,
}

#: File name endings and their language.
ENDINGS = {
    ".py": "python", ".js": "javascript", ".ts": "typescript", ".go": "go", ".java": "java",
    ".json": "json", ".yaml": "yaml", ".toml": "toml", ".xml": "xml",
}

#: Languages in which a text without any token is whole.
EMPTY_OK = frozenset(["python", "javascript", "typescript", "java", "yaml", "toml"])


@lru_cache(maxsize=None)
def grammar(language: str) -> Grammar:
    """The compiled grammar; later rules of a text replace earlier ones of the name."""
    return Grammar(TEXTS[language])
