"""Grammars and lexers of the languages whose files are tested for validity.

The grammars accept a language's structure and leave names, types and operator precedence
aside.  Dialects (Python 3 and 2; script and module; plain and typed scripts; Java with old and
arrow switches; Rust editions; Go with and without type parameters) are alternatives of one
start rule and run together.
"""

from __future__ import annotations

import re
from functools import lru_cache

from siftline.llm.gll import NEVER, Grammar, Recogniser
from siftline.llm.nesting import flat_rust, flat_script

# ---------------------------------------------------------------------------- JSON
JSON = """
file = value
value = STR | NUM | 'true' | 'false' | 'null' | '{' (pair (',' pair)*)? '}' | '[' (value (',' value)*)? ']'
pair = STR ':' value
"""

# ---------------------------------------------------------------------------- Python
_PY_SHARED = """
dotted = name ('.' name)*
import = dotted ('as' name)?
froms = '(' fromname (',' fromname)* ','? ')' | fromname (',' fromname)*
fromname = name ('as' name)?
name = NAME | 'match' | 'case' | 'type' | 'print' | 'exec' | 'nonlocal' | 'async' | 'await'
exprs = starred (',' starred)* ','?
starred = '*'? expr
expr = test | 'lambda' params? ':' expr | name ':=' expr
test = operand (binop operand)* ('if' test 'else' expr)?
binop = '+' | '-' | '*' | '/' | '//' | '%' | '@' | '**' | '<<' | '>>' | '&' | '|' | '^' | '<' | '>' | '<=' | '>=' | '==' | '!=' | 'in' | 'not' 'in' | 'is' 'not'? | 'and' | 'or'
operand = ('-' | '+' | '~' | 'not' | 'await')* atom trailer*
atom = name | NUM | STR+ | 'None' | 'True' | 'False' | '...' | '(' (yield | inside)? ')' | '[' inside? ']' | '{' (dictitem (comp | (',' dictitem)* ','?))? '}' | '{' inside '}'
inside = starred (comp | (',' starred)* ','?)
dictitem = '**' operand | expr ':' expr
comp = ('async'? 'for' targets 'in' test ('if' test)*)+
targets = target (',' target)* ','?
target = '*'? atom trailer*
trailer = '(' args? ')' | '[' subs ']' | '.' name
args = arg (',' arg)* ','?
arg = expr comp? | '*' expr | '**' expr | name '=' expr
subs = sub (',' sub)* ','?
sub = starred | expr? ':' expr? (':' expr?)?
yield = 'yield' ('from' expr | exprs)?
params = param (',' param)* ','?
param = name ('=' expr)? | '*' name? | '**' name | '/' | '(' name (',' name)* ','? ')' ('=' expr)?
augment = '+=' | '-=' | '*=' | '/=' | '//=' | '%=' | '@=' | '&=' | '|=' | '^=' | '>>=' | '<<=' | '**='
"""
_PY3 = """
file3 = (NL | stmt3)*
stmt3 = simple3 | compound3
simple3 = small3 (';' small3)* ';'? NL
small3 = 'pass' | 'break' | 'continue' | 'return' exprs? | 'raise' (expr ('from' expr)?)? | 'global' name (',' name)* | 'nonlocal' name (',' name)* | 'del' exprs | 'assert' expr (',' expr)?
  | 'import' import (',' import)* | 'from' ('.' | '...')* dotted 'import' ('*' | froms) | 'from' ('.' | '...')+ 'import' ('*' | froms) | 'type' name tparams? '=' expr
  | exprs (':' expr ('=' (yield | exprs))? | augment (yield | exprs) | ('=' exprs)* ('=' yield)?) | yield
suite3 = simple3 | NL INDENT NL* (stmt3 NL*)+ DEDENT
compound3 = 'if' expr ':' suite3 ('elif' expr ':' suite3)* ('else' ':' suite3)? | 'while' expr ':' suite3 ('else' ':' suite3)?
  | 'async'? 'for' targets 'in' exprs ':' suite3 ('else' ':' suite3)? | 'async'? 'with' withs ':' suite3
  | 'try' ':' suite3 (('except' '*'? (exprs ('as' name)?)? ':' suite3)+ ('else' ':' suite3)? ('finally' ':' suite3)? | 'finally' ':' suite3)
  | ('@' expr NL)* (def3 | 'class' name tparams? ('(' args? ')')? ':' suite3) | 'match' exprs ':' NL INDENT ('case' patterns ('if' expr)? ':' suite3)+ DEDENT
withs = with (',' with)* | '(' with (',' with)* ','? ')'
with = expr ('as' target)?
def3 = 'async'? 'def' name tparams? '(' params3? ')' ('->' expr)? ':' suite3
params3 = param3 (',' param3)* ','?
param3 = name (':' expr)? ('=' expr)? | '*' (name (':' starred)?)? | '**' name (':' expr)? | '/'
tparams = '[' tparam (',' tparam)* ','? ']'
tparam = ('*' | '**')? name (':' expr)? ('=' expr)?
patterns = pattern (',' pattern)* ','?
pattern = '*' name | '**' name | closed ('|' closed)* ('as' name)? | closed ':' pattern
closed = ('-' | '+')? NUM (('+' | '-') NUM)? | STR+ | 'None' | 'True' | 'False' | dotted ('(' (parg (',' parg)* ','?)? ')')? | '(' patterns? ')' | '[' patterns? ']' | '{' patterns? '}'
parg = pattern | name '=' pattern
"""
_PY2 = """
file2 = (NL | stmt2)*
stmt2 = simple2 | compound2
simple2 = small2 (';' small2)* ';'? NL
small2 = 'pass' | 'break' | 'continue' | 'return' exprs? | 'raise' (expr (',' expr (',' expr)?)?)? | 'global' name (',' name)* | 'del' exprs | 'assert' expr (',' expr)?
  | 'import' import (',' import)* | 'from' ('.' | '...')* dotted 'import' ('*' | froms) | 'from' ('.' | '...')+ 'import' ('*' | froms)
  | 'print' (('>>' expr (',' exprs)?) | exprs)? | 'exec' expr ('in' expr (',' expr)?)? | exprs (augment (yield | exprs) | ('=' exprs)* ('=' yield)?) | yield
suite2 = simple2 | NL INDENT NL* (stmt2 NL*)+ DEDENT
compound2 = 'if' expr ':' suite2 ('elif' expr ':' suite2)* ('else' ':' suite2)? | 'while' expr ':' suite2 ('else' ':' suite2)? | 'for' targets 'in' exprs ':' suite2 ('else' ':' suite2)?
  | 'with' with (',' with)* ':' suite2 | 'try' ':' suite2 (('except' (expr (('as' | ',') target)?)? ':' suite2)+ ('else' ':' suite2)? ('finally' ':' suite2)? | 'finally' ':' suite2)
  | ('@' dotted ('(' args? ')')? NL)* ('def' name '(' params? ')' ':' suite2 | 'class' name ('(' exprs? ')')? ':' suite2)
"""
PYTHON = "\nfile = file3 | file2\n" + _PY3 + _PY2 + _PY_SHARED

# ---------------------------------------------------------------------------- JavaScript and TypeScript
_SCRIPT = """
file = HASHBANG? NL* items
items = (decl NL* | simple terms | ';' | NL)* simple?
terms = (';' | NL)+
ident = NAME | 'async' | 'of' | 'get' | 'set' | 'static' | 'from' | 'as' | 'let' | 'type' | 'interface' | 'namespace' | 'module' | 'declare' | 'abstract' | 'readonly' | 'private' | 'public' | 'protected' | 'is' | 'keyof' | 'infer' | 'override' | 'satisfies' | 'asserts' | 'unique' | 'implements' | 'enum' | 'any' | 'global' | 'accessor' | 'target' | 'meta' | 'undefined' | 'out'
block = '{' NL* items '}'
body = block
simple = 'var' binds | 'let' binds | 'const' binds | 'return' exprs? | 'throw' exprs | 'break' ident? | 'continue' ident? | 'debugger' | exprs | 'do' NL* stmt NL* 'while' '(' exprs ')'
  | 'import' STR attrs? | 'import' importclause 'from' STR attrs? | 'export' '{' (spec (',' spec)* ','?)? '}' ('from' STR attrs?)? | 'export' '*' ('as' word)? 'from' STR attrs? | 'export' 'default' exprs
  | 'export' ('const' | 'let' | 'var') binds | tsimple
attrs = ('with' | 'assert') object
importclause = typeword? ident | typeword? (ident ',')? ('{' (spec (',' spec)* ','?)? '}' | '*' 'as' ident)
spec = typeword? (word | STR) ('as' (word | STR))?
word = ANYWORD
stmt = decl NL* | simple terms | simple | ';'
decl = block | 'if' '(' exprs ')' NL* stmt (NL* 'else' NL* stmt)? | 'while' '(' exprs ')' NL* stmt | 'for' 'await'? '(' forhead ')' NL* stmt | 'with' '(' exprs ')' NL* stmt
  | 'switch' '(' exprs ')' '{' NL* (('case' exprs | 'default') ':' items)* '}' | 'try' block (NL* 'catch' ('(' target tann? ')')? block)? (NL* 'finally' block)? | ident ':' NL* stmt
  | 'export'? 'default'? function | 'export'? 'default'? class | tdecl
forhead = (('var' | 'let' | 'const') binds | exprs)? ';' exprs? ';' exprs? | (('var' | 'let' | 'const') target | operand) ('of' | 'in') exprs
binds = bind (',' bind)*
bind = target bang tann? ('=' expr)?
target = ident | '[' (',' | telem)* ']' | '{' (tprop (',' tprop)* ','?)? '}'
telem = '...'? target ('=' expr)?
tprop = '...' target | key (':' target)? ('=' expr)?
function = 'async'? 'function' '*'? ident? tparams? '(' params? ')' tret? body | tsignature
params = param (',' param)* ','?
param = decorator* tmods '...'? target topt tann? ('=' expr)? | 'this' tann
class = (decorator NL*)* tabstract 'class' ident? tparams? ('extends' operand)? timpl? '{' (member | ';' | NL)* '}'
decorator = '@' ident ('.' word)* ('(' args? ')')? | '@' '(' exprs ')'
member = (decorator NL*)* tmembermods (('static' | 'async' | 'get' | 'set' | 'accessor')* '*'? key topt tparams? '(' params? ')' tret? tbody | ('static' | 'accessor')* key topt bang tann? ('=' expr)? (';' | NL)+ | ('static' | 'accessor')* key topt bang tann? ('=' expr)? | 'static' block | tindex) | (decorator NL*)* tabs key topt tparams? '(' params? ')' tret?
tbody = body
key = word | STR | NUM | PRIVATE | '[' expr ']'
exprs = expr (',' expr)*
expr = arrow | 'yield' '*'? expr? | operand (binop operand | '?' expr ':' expr | tcast | '=' expr | assign expr)*
assign = '+=' | '-=' | '*=' | '/=' | '%=' | '**=' | '&=' | '|=' | '^=' | '<<=' | '>' '>' '=' | '>' '>' '>' '=' | '&&=' | '||=' | '??='
arrow = 'async'? (ident | tparams? '(' params? ')' tret?) '=>' (body | expr)
binop = '+' | '-' | '*' | '/' | '%' | '**' | '&' | '|' | '^' | '<' | '>' | '<=' | '>' '=' | '<<' | '>' '>' | '>' '>' '>' | '==' | '!=' | '===' | '!==' | '&&' | '||' | '??' | 'in' | 'instanceof'
operand = ('-' | '+' | '~' | '!' | '++' | '--' | 'typeof' | 'void' | 'delete' | 'await')* (atom post* | tassert) ('++' | '--')?
atom = ident | NUM | STR | TEMPLATE | REGEX | PRIVATE | 'this' | 'super' | 'null' | 'true' | 'false' | '(' exprs ')' | '[' (',' | '...'? expr)* ']' | object | 'async'? 'function' '*'? ident? tparams? '(' params? ')' tret? body | class
  | 'new' ('.' word | operandnew) | 'import' ('(' args ')' | '.' word)
operandnew = ('new')* (ident | 'this' | 'super' | '(' exprs ')' | class | function | 'import' '.' word) (('.' | '?.') (word | PRIVATE) | '[' exprs ']')* targs? ('(' args? ')')?
post = '.' (word | PRIVATE) | '?.' (word | PRIVATE | '[' exprs ']' | '(' args? ')') | '[' exprs ']' | '(' args? ')' | TEMPLATE | tpost
args = arg (',' arg)* ','?
arg = '...'? expr
object = '{' (prop (',' prop)* ','?)? '}'
prop = '...' expr | ident ('=' expr)? | key ':' expr | ('async' | 'get' | 'set')* '*'? key tparams? '(' params? ')' tret? body
"""
_PLAIN = """
bang = ()
tann = NEVER
topt = ()
tret = NEVER
tmods = ()
tmembermods = ()
tabs = NEVER
tabstract = ()
timpl = NEVER
tindex = NEVER
tparams = NEVER
targs = NEVER
tpost = NEVER
tcast = NEVER
tassert = NEVER
tsimple = NEVER
tdecl = NEVER
tsignature = NEVER
typeword = NEVER
"""
_TYPED = """
bang = '!'?
tann = ':' type
topt = '?'?
tret = ':' (type | ident 'is' type | 'this' 'is' type | 'asserts' (ident | 'this') ('is' type)?)
tmods = ('private' | 'public' | 'protected' | 'readonly' | 'override')*
tmembermods = ('private' | 'public' | 'protected' | 'readonly' | 'override' | 'abstract' | 'declare' | 'static')*
tabstract = 'abstract'?
tabs = ('private' | 'public' | 'protected' | 'override')* 'abstract' ('private' | 'public' | 'protected' | 'override')*
timpl = 'implements' type (',' type)*
tindex = '[' ident ':' type ']' tann? (';' | NL)*
tparams = '<' tparam (',' tparam)* ','? '>'
tparam = ('const' | 'in' | 'out')* ident ('extends' type)? ('=' type)?
targs = '<' type (',' type)* '>'
tpost = targs ('(' args? ')' | TEMPLATE) | '!'
tcast = ('as' | 'satisfies') (type | 'const')
tassert = '<' type '>' operand
tsimple = 'export'? 'declare'? 'type' ident tparams? '=' type | 'export' '=' exprs | 'import' ident '=' exprs | 'export' 'as' 'namespace' ident | 'export'? 'declare' ('const' | 'let' | 'var') binds | typeword '{' (spec (',' spec)* ','?)? '}' ('from' STR)?
tdecl = 'export'? 'default'? 'declare'? 'interface' ident tparams? ('extends' type (',' type)*)? tobject | 'export'? 'declare'? 'const'? 'enum' ident '{' NL* (key ('=' expr)? (',' NL* key ('=' expr)?)* ','?)? NL* '}'
  | 'export'? 'declare'? ('namespace' | 'module') (ident ('.' ident)* | STR) block | 'declare' 'global' block | 'export'? 'default'? 'declare' (function | class)
tsignature = 'async'? 'function' ident tparams? '(' params? ')' tret? terms
typeword = 'type'
type = 'asserts'? union ('extends' type '?' type ':' type)? | tparams? '(' params? ')' '=>' (type | ident 'is' type | 'this' 'is' type) | 'abstract'? 'new' tparams? '(' params? ')' '=>' type
union = ('|' | '&')? unary (('|' | '&') unary)*
unary = ('keyof' | 'unique' | 'readonly' | 'infer')* primary ('[' type? ']')* ('extends' type)?
primary = (ident | 'void' | 'this') ('.' word)* targs? | 'null' | 'true' | 'false' | '-'? NUM | STR | TEMPLATE | '(' type ')' | '[' (telement (',' telement)* ','?)? ']' | tobject | 'typeof' ('import' '(' STR ')' | ident | 'this') ('.' word)* targs? | 'import' '(' STR ')' ('.' word)* targs?
telement = '...'? (ident '?'? ':')? type '?'?
tobject = '{' (tmember | ';' | ',' | NL)* '}'
tmember = ('readonly' | '-' | '+')* ('get' | 'set')? key ('?' | '-' '?' | '+' '?')? tann? | ('get' | 'set' | 'new')? key? '?'? tparams? '(' params? ')' tret? | ('readonly' | '-' | '+')* '[' ident (':' type | 'in' type ('as' type)?) ']' ('?' | '-' '?' | '+' '?')? tann?
"""
JAVASCRIPT = _SCRIPT + _PLAIN
TYPESCRIPT = _SCRIPT.replace("tbody = body", "tbody = body | ';' | NL") + _TYPED

# ---------------------------------------------------------------------------- Java
JAVA = """
file = (annotation* 'package' dotted ';')? ('import' 'static'? ident ('.' ident)* ('.' '*')? ';' | ';')* (typedecl | ';')* | (annotation | 'open')* 'module' dotted '{' (word+ dotted (word dotted (',' dotted)*)? ';')* '}'
ident = NAME | 'record' | 'var' | 'yield' | 'sealed' | 'permits' | 'when' | 'module' | 'open' | 'non'
word = ANYWORD
dotted = ident ('.' ident)*
mod = annotation | 'public' | 'private' | 'protected' | 'static' | 'final' | 'abstract' | 'native' | 'synchronized' | 'transient' | 'volatile' | 'strictfp' | 'default' | 'sealed' | 'non' '-' 'sealed'
annotation = '@' dotted ('(' (pair (',' pair)* ','? | value)? ')')?
pair = ident '=' value
value = annotation | expr | '{' (value (',' value)*)? ','? '}'
typedecl = mod* (class | interface | enum | record | '@' 'interface' ident '{' member* '}')
class = 'class' ident tparams? ('extends' type)? ('implements' types)? ('permits' types)? cbody
interface = 'interface' ident tparams? ('extends' types)? ('permits' types)? cbody
enum = 'enum' ident ('implements' types)? '{' (constant (',' constant)*)? ','? (';' member*)? '}'
constant = annotation* ident ('(' args? ')')? cbody?
record = 'record' ident tparams? '(' params? ')' ('implements' types)? cbody
cbody = '{' member* '}'
member = ';' | mod* block | typedecl | mod* tparams? (type ident | ident | 'void' ident) '(' params? ')' dims ('throws' types)? ('default' value)? (block | ';') | mod* tparams? ident block | mod* type binds ';'
binds = bind (',' bind)*
bind = ident dims ('=' init)?
init = expr | '{' (init (',' init)*)? ','? '}'
dims = (annotation* '[' ']')*
params = param (',' param)*
param = mod* type annotation* '...'? (ident '.')? (ident | 'this') dims
types = type (',' type)*
tparams = '<' tparam (',' tparam)* '>'
tparam = annotation* ident ('extends' type ('&' type)*)?
type = annotation* ('boolean' | 'byte' | 'short' | 'int' | 'long' | 'char' | 'float' | 'double' | ident targs? ('.' annotation* ident targs?)*) dims
targs = '<' (targ (',' targ)*)? '>'
targ = type | annotation* '?' (('extends' | 'super') type)?
block = '{' stmt* '}'
stmt = block | ';' | mod* type binds ';' | typedecl | expr ';' | 'if' '(' expr ')' stmt ('else' stmt)? | 'while' '(' expr ')' stmt | 'do' stmt 'while' '(' expr ')' ';'
  | 'for' '(' (mod* type binds | expr (',' expr)*)? ';' expr? ';' (expr (',' expr)*)? ')' stmt | 'for' '(' mod* type ident dims ':' expr ')' stmt
  | 'return' expr? ';' | 'throw' expr ';' | 'break' ident? ';' | 'continue' ident? ';' | 'yield' expr ';' | 'synchronized' '(' expr ')' block | 'assert' expr (':' expr)? ';' | ident ':' stmt
  | 'try' ('(' resource (';' resource)* ';'? ')')? block ('catch' '(' mod* type ('|' type)* ident ')' block)* ('finally' block)? | switch
resource = mod* type ident '=' expr | expr
switch = 'switch' '(' expr ')' '{' (('case' label (',' label)* ('when' expr)? | 'default') (':' | '->') stmt*)* '}'
label = expr | 'default' | pattern
pattern = mod* type ident | type '(' (pattern (',' pattern)*)? ')' ident?
expr = lambda | operand (binop operand | 'instanceof' ('final'? type ident? | pattern) | '?' expr ':' expr | '=' expr | assign expr)*
lambda = (ident | '(' (params | ident (',' ident)*)? ')') '->' (block | expr)
assign = '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>' '>' '=' | '>' '>' '>' '='
binop = '+' | '-' | '*' | '/' | '%' | '&' | '|' | '^' | '<' | '>' | '<=' | '>' '=' | '<<' | '>' '>' | '>' '>' '>' | '==' | '!=' | '&&' | '||'
operand = ('-' | '+' | '~' | '!' | '++' | '--')* (atom post* ('++' | '--')? | '(' type ('&' type)* ')' (operand | lambda))
atom = ident | NUM | STR | CHAR | 'this' | 'super' | 'null' | 'true' | 'false' | '(' expr ')' | 'new' targs? annotation* (type '(' args? ')' cbody? | newtype ('[' expr ']')+ dims | newtype dims init) | type '::' ('new' | ident) | type '.' 'class' | 'void' '.' 'class' | switch | (ident | 'this' | 'super') '(' args? ')'
newtype = annotation* ('boolean' | 'byte' | 'short' | 'int' | 'long' | 'char' | 'float' | 'double' | ident targs? ('.' ident targs?)*)
post = '.' targs? (ident | 'this' | 'class' | 'super') ('(' args? ')')? | '.' 'new' type '(' args? ')' cbody? | '[' expr ']' | '::' targs? (ident | 'new')
args = expr (',' expr)*
"""

# ---------------------------------------------------------------------------- Go
GO = """
file = 'package' NAME ';'+ ('import' (imp | '(' (imp (';' | ';' ';')?)* ')') ';')* (top ';')* top?
imp = ('.' | NAME)? STR
top = decl | 'func' receiver? NAME tparams? signature block?
receiver = params
decl = ('var' | 'const') (vspec | '(' (vspec ';')* vspec? ')') | 'type' (tspec | '(' (tspec ';')* tspec? ')')
vspec = NAME (',' NAME)* type? ('=' exprs)?
tspec = NAME tparams? '='? type
tparams = '[' tparam (',' tparam)* ','? ']'
tparam = NAME (',' NAME)* constraint
constraint = '~'? type ('|' '~'? type)*
signature = params (params | type)?
params = '(' (param (',' param)* ','?)? ')'
param = NAME? '...'? type
type = NAME ('.' NAME)? targs? | '*' type | '(' type ')' | '[' (expr | '...')? ']' type | 'map' '[' type ']' type | ('<-' 'chan' | 'chan' '<-'?) type | 'func' signature | 'struct' '{' (field ';')* field? '}' | 'interface' '{' (elem ';')* elem? '}'
targs = '[' type (',' type)* ','? ']'
field = (NAME (',' NAME)* type | '*'? NAME ('.' NAME)? targs?) STR?
elem = NAME signature | constraint
block = '{' stmts '}'
stmts = (stmt? ';')* stmt?
stmt = decl | block | NAME ':' stmt? | 'return' exprs? | 'break' NAME? | 'continue' NAME? | 'goto' NAME | 'fallthrough' | 'go' expr | 'defer' expr | simple | if | 'for' forhead? block | 'switch' (simple? ';')? simple? '{' (cases ':' stmts)* '}' | 'select' '{' (cases ':' stmts)* '}'
cases = 'case' (simple | types) | 'default'
types = type (',' type)*
if = 'if' (simple? ';')? simple block ('else' (if | block))?
forhead = simple | simple? ';' expr? ';' simple? | (exprs (':=' | '='))? 'range' expr
simple = exprs (('=' | ':=' | assign) exprs | '++' | '--' | '<-' expr)?
assign = '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>>=' | '&^='
exprs = expr (',' expr)*
expr = operand (binop operand)*
binop = '+' | '-' | '*' | '/' | '%' | '&' | '|' | '^' | '&^' | '<<' | '>>' | '<' | '>' | '<=' | '>=' | '==' | '!=' | '&&' | '||'
operand = ('-' | '+' | '!' | '^' | '*' | '&' | '<-')* atom post*
atom = NAME | NUM | STR | CHAR | '(' (expr | type) ')' | 'func' signature block | littype literal | ('[' ']' | 'map' '[' type ']') type | 'struct' '{' '}' | ('<-' 'chan' | 'chan' '<-'?) type | 'interface' '{' '}'
littype = NAME ('.' NAME)? targs? | '[' (expr | '...')? ']' type | 'map' '[' type ']' type | 'struct' '{' (field ';')* field? '}'
literal = '{' (element (',' element)* ','?)? '}'
element = (expr | literal) (':' (expr | literal))?
post = '.' NAME | '.' '(' ('type' | type) ')' | '[' expr? (':' expr?)? (':' expr?)? ']' | '[' type (',' type)* ']' | '(' (arg (',' arg)* ','?)? ')'
arg = (expr | type) '...'?
"""

# ---------------------------------------------------------------------------- Rust
RUST = """
file = HASHBANG? inner* item*
ident = NAME | 'union' | 'auto' | 'default' | 'macro_rules' | 'raw' | 'async' | 'dyn' | 'try' | 'await'
inner = '#' '!' '[' tree* ']'
attr = '#' '[' tree* ']'
tree = '(' tree* ')' | '[' tree* ']' | '{' tree* '}' | TREE
vis = 'pub' ('(' ('in'? path) ')')?
item = attr* vis? (use | module | function | struct | enum | union | impl | trait | const | typedef | extern | 'macro_rules' '!' ident macroarg ';'? | macroitem)
macroitem = path '!' ident? ('{' tree* '}' | ('(' tree* ')' | '[' tree* ']') ';')
macroarg = '(' tree* ')' | '[' tree* ']' | '{' tree* '}'
use = 'use' usetree ';'
usetree = '::'? (seg '::')* ('*' | '{' (usetree (',' usetree)* ','?)? '}' | seg ('as' (ident | '_'))?)
seg = ident | 'crate' | 'self' | 'super' | 'Self'
module = 'unsafe'? 'mod' ident (';' | '{' inner* item* '}')
extern = 'extern' 'crate' (ident | 'self') ('as' ident)? ';' | 'unsafe'? 'extern' STR? '{' inner* item* '}'
function = ('const' | 'async' | 'unsafe' | 'extern' STR?)* 'fn' ident generics? '(' (fparam (',' fparam)* ','?)? ')' ('->' type)? where? (block | ';')
fparam = attr* ('&' LIFETIME? 'mut'? 'self' | 'mut'? 'self' (':' type)? | pattern ':' type | type | '...')
generics = '<' (gparam (',' gparam)* ','?)? '>'
gparam = attr* (LIFETIME (':' bounds?)? | ident (':' bounds?)? ('=' type)? | 'const' ident ':' type ('=' (block | '-'? NUM | ident))?)
where = 'where' (wpred (',' wpred)* ','?)?
wpred = LIFETIME ':' bounds? | forall? type ':' bounds?
bounds = bound ('+' bound)* '+'?
bound = LIFETIME | '?'? 'const'? forall? path | '(' '?'? forall? path ')' | 'use' '<' (tree2 (',' tree2)*)? '>'
tree2 = LIFETIME | ident
forall = 'for' generics
struct = 'struct' ident generics? where? (';' | '{' (sfield (',' sfield)* ','?)? '}' | '(' (tfield (',' tfield)* ','?)? ')' where? ';')
union = 'union' ident generics? where? '{' (sfield (',' sfield)* ','?)? '}'
sfield = attr* vis? ident ':' type
tfield = attr* vis? type
enum = 'enum' ident generics? where? '{' (variant (',' variant)* ','?)? '}'
variant = attr* vis? ident ('{' (sfield (',' sfield)* ','?)? '}' | '(' (tfield (',' tfield)* ','?)? ')')? ('=' expr)?
impl = ('default' | 'unsafe')* 'impl' generics? ('!'? type 'for')? type where? '{' inner* assoc* '}'
trait = ('unsafe' | 'auto')* 'trait' ident generics? (':' bounds?)? where? '{' inner* assoc* '}' | 'trait' ident generics? '=' bounds where? ';'
assoc = attr* vis? 'default'? (function | const | typedef | macroitem)
const = ('const' (ident | '_') | 'static' 'mut'? ident) generics? ':' type ('=' expr)? ';'
typedef = 'type' ident generics? (':' bounds?)? where? ('=' type where?)? ';'
type = path | '&' LIFETIME? 'mut'? type | '&&' LIFETIME? 'mut'? type | '*' ('const' | 'mut') type | '(' (type (',' type)* ','?)? ')' | '[' type (';' expr)? ']' | '!' | '_' | ('dyn' | 'impl') bounds | forall? ('unsafe' | 'extern' STR?)* 'fn' '(' (farg (',' farg)* ','?)? ')' ('->' type)? | path '!' macroarg | forall path
farg = attr* ((ident | '_') ':')? type | '...'
path = '::'? pseg ('::' pseg)* | qpath
qpath = '<' type ('as' path)? '>' ('::' pseg)+
pseg = seg ('::'? targs | '(' (type (',' type)* ','?)? ')' ('->' type)?)?
targs = '<' (targ (',' targ)* ','?)? '>'
targ = LIFETIME | type | ident targs? ('=' type | ':' bounds) | '-'? NUM | STR | CHAR | 'true' | 'false' | block
epath = '::'? eseg ('::' eseg)* | qpath
eseg = seg | targs
block = '{' inner* stmt* last? '}'
last = attr* expr
stmt = ';' | item | attr* 'let' pattern (':' type)? ('=' expr ('else' block)?)? ';' | attr* expr ';' | attr* blocky | epath '!' '{' tree* '}'
blocky = (LIFETIME ':')? ('unsafe' | 'const' | 'async' 'move'?)? block | if | 'match' expr '{' inner* (arm)* '}' | (LIFETIME ':')? 'while' cond block | (LIFETIME ':')? 'loop' block | (LIFETIME ':')? 'for' pattern 'in' expr block
if = 'if' cond block ('else' (if | block))?
cond = condpart ('&&' condpart)*
condpart = 'let' pattern '=' expr | expr
arm = attr* pattern ('if' cond)? '=>' (blocky ','? | expr ',' | expr)
pattern = '|'? pat ('|' pat)*
pat = ('ref' | 'mut')* ident ('@' pat)? | '&' 'mut'? pat | '&&' 'mut'? pat | '_' | '..' | lit (range lit?)? | range lit | epath (range lit?)? | epath '(' (pattern (',' pattern)* ','?)? ')' | epath '{' (fpat (',' fpat)* ','?)? '}' | '(' (pattern (',' pattern)* ','?)? ')' | '[' (pattern (',' pattern)* ','?)? ']' | epath '!' macroarg | 'box' pat | 'const' block
fpat = attr* ('..' | (ident | NUM) ':' pattern | 'ref'? 'mut'? ident)
lit = '-'? NUM | STR | CHAR | 'true' | 'false' | epath
range = '..' | '..=' | '...'
expr = ('..' | '..=') | ('..' | '..=')? operand (binop operand | ('..' | '..=') operand? | 'as' type | '=' expr | assign expr)* | 'return' expr? | 'break' LIFETIME? expr? | 'continue' LIFETIME? | closure | 'yield' expr?
closure = ('static' | 'async' | 'move' | forall)* ('||' | '|' (cparam (',' cparam)* ','?)? '|') ('->' type block | expr)
cparam = attr* pat (':' type)?
assign = '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>' '>' '='
binop = '+' | '-' | '*' | '/' | '%' | '&' | '|' | '^' | '<' | '>' | '<=' | '>' '=' | '<<' | '>' '>' | '==' | '!=' | '&&' | '||'
operand = ('-' | '!' | '*' | '&' 'mut'? | '&&' 'mut'? | '&' 'raw' ('const' | 'mut'))* (atom post* | closure | 'return' expr? | 'break' LIFETIME? expr? | 'continue' LIFETIME?)
atom = NUM | STR | CHAR | 'true' | 'false' | '_' | epath | epath '!' macroarg | epath '{' ((finit (',' finit)*)? ','? ('..' expr?)?) '}' | '(' (expr (',' expr)* ','?)? ')' | '[' (expr (';' expr | (',' expr)* ','?))? ']' | blocky
finit = attr* ((ident | NUM) ':' expr | ident)
post = '.' (ident ('::' targs)? | NUM) | '(' (expr (',' expr)* ','?)? ')' | '[' expr ']' | '?'
"""

# ---------------------------------------------------------------------------- lexers
_NUM = r"(?:0[xX][0-9a-fA-F_]+|0[bB][01_]+|0[oO]?[0-7_]+(?![\d.eE])|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?[\d_]+)?)"
_WORD = r"[^\W\d]\w*"
_SQ, _DQ = r"'(?:[^'\\\n]|\\[\s\S])*'", r'"(?:[^"\\\n]|\\[\s\S])*"'
_C = r"//[^\n]*|/\*[\s\S]*?\*/"


class Lexer(dict):
    """Token text -> its characters in the grammar's alphabet; filled on first sight, emptied when large."""

    def __init__(self, grammar: Grammar, pattern: str, line: str | None = None):
        super().__init__()
        self.g, self.line = grammar, line
        self.find = re.compile(pattern).findall
        self.bad = NEVER

    def __missing__(self, t: str) -> str:
        if len(self) > 300_000:
            self.clear()
        self[t] = c = self.kind(t)
        return c

    def kind(self, t: str) -> str:
        k, c = self.g.tokens, t[0]
        if c.isspace():
            return self.line if self.line and "\n" in t else ""
        if t.startswith(("//", "/*")) and len(t) > 1 and (t[1] == "/" or t.endswith("*/")):
            return self.line if self.line and "\n" in t else ""
        if t in k and not t.isupper():
            return k[t]
        if c.isalpha() or c == "_" or c == "$" or ord(c) > 127:
            return self.word(t)
        if c.isdigit() or (c == "." and len(t) > 1 and t[1].isdigit()):
            return k["NUM"]
        if c in "\"'`" and len(t) > 1:
            return self.string(t)
        return self.bad

    def word(self, t: str) -> str:
        return self.g.tokens["NAME"] if t.replace("$", "a").isidentifier() else self.bad

    def string(self, t: str) -> str:
        return self.g.tokens["STR"]

    def tokens(self, text: str) -> str:
        return "".join([self[t] for t in self.find(text)])


class JsonLexer(Lexer):
    def __init__(self, grammar: Grammar):
        super().__init__(grammar, r'[ \t\r\n]+|"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.])|\w+|[\s\S]')

    def kind(self, t: str) -> str:
        k = self.g.tokens
        if t[0] in " \t\r\n":
            return ""
        if t in k and not t.isupper():
            return k[t]
        return k["STR"] if t[0] == '"' and len(t) > 1 else k["NUM"] if re.fullmatch(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?", t) else self.bad


class PythonLexer(Lexer):
    def __init__(self, grammar: Grammar):
        prefix = r"(?:[rRbBuUfFtT]|[rR][bBfFtT]|[bBfFtT][rR]|[uU][rR])?"
        tri = rf"{prefix}(?:\"\"\"(?:[^\"\\]|\\[\s\S]|\"(?!\"\"))*\"\"\"|'''(?:[^'\\]|\\[\s\S]|'(?!''))*''')"
        super().__init__(
            grammar,
            rf"\n[ \t\f]*|[ \t\f\r]+|\\\r?\n|#[^\n]*|{tri}|{prefix}(?:{_SQ}|{_DQ})|(?:{_NUM}[jJlL]?)(?!\w)|{_WORD}|\*\*=|//=|<<=|>>=|\.\.\.|->|:=|\*\*|//|<<|>>|<>|<=|>=|==|!=|[+\-*/%@&|^]=|[\s\S]",
        )

    def kind(self, t: str) -> str:
        k, c = self.g.tokens, t[0]
        if c == "\\" or c == "#" or c in " \t\f\r\n":
            return "" if t != "\\" else self.bad
        if t in k and not t.isupper():
            return k[t]
        if t == "<>":
            return k["!="]
        if t[-1] in "\"'" and len(t) > 1:
            return k["STR"]
        return super().kind(t) if c not in "$`" else self.bad

    def tokens(self, text: str) -> str:
        """With NL at the end of logical lines, INDENT and DEDENT; a dedent to no open level is an error."""
        k = self.g.tokens
        nl, ind, ded = k["NL"], k["INDENT"], k["DEDENT"]
        out, depth, levels, fresh = [], 0, [0], True  # fresh: no token in this logical line yet
        width = 0
        if text.startswith("﻿"):
            text = text[1:]
        found = self.find(text)
        if found and found[0][0] in " \t":
            width = len(found[0].expandtabs())
        for t in found:
            if t[0] == "\n":
                if depth:
                    continue
                if not fresh:
                    out.append(nl)
                    fresh = True
                width = len(t.expandtabs()) - 1 if "\t" in t else len(t) - 1
                continue
            c = self[t]
            if not c:
                continue
            if fresh:
                fresh = False
                if width != levels[-1]:
                    if width > levels[-1]:
                        levels.append(width)
                        out.append(ind)
                    else:
                        while width < levels[-1]:
                            levels.pop()
                            out.append(ded)
                        if width != levels[-1]:
                            out.append(self.bad)
            if t in "([{":
                depth += 1
            elif t in ")]}":
                depth = max(0, depth - 1)
            out.append(c)
        if not fresh:
            out.append(nl)
        out.append(ded * (len(levels) - 1))
        return "".join(out)


class ScriptLexer(Lexer):
    """Line ends stay only where a statement can end before and begin behind them."""

    def __init__(self, grammar: Grammar):
        braces = r"\{(?:[^{}`\"']|%s|%s|`(?:[^`\\]|\\[\s\S])*`|\{(?:[^{}]|\{[^{}]*\})*\})*\}" % (_SQ, _DQ)
        template = rf"`(?:[^`\\$]|\\[\s\S]|\$(?!\{{)|\${braces})*`"
        regex = r"/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*"
        super().__init__(
            grammar,
            rf"\s+|{_C}|{template}|{_SQ}|{_DQ}|(?:return|typeof|case|in|of|=>|[(,=:\[!&|?{{}};+<>*%~^-])\s*{regex}|(?:{_NUM}n?)(?![\w$])|#?[^\W\d]*[\w$]+|#![^\n]*|\.\.\.|===|!==|\*\*=|<<=|&&=|\|\|=|\?\?=|=>|==|!=|<=|<<|\+\+|--|&&|\|\||\?\?|\?\.(?!\d)|\*\*|[+\-*/%&|^]=|[\s\S]",
            grammar.tokens["NL"],
        )
        k = grammar.tokens
        after = [k[x] for x in ("NAME", "NUM", "STR", "TEMPLATE", "REGEX", "PRIVATE", ")", "]", "}", "++", "--", "!")]
        after += [k[x] for x in grammar.words if x not in ("in", "instanceof", "typeof", "void", "delete", "new", "case", "else", "do", "extends", "const", "var", "function", "class", "import", "export", "throw", "await")]
        after += [k["*"]] if "*" in k else []
        no = [k[x] for x in (")", "]", ",", ".", "?.", ";", ":", "?", "=", "=>", "{", "in", "instanceof", "+", "-", "/", "%", "&", "|", "^", "<", ">", "<=", "<<", "==", "!=", "===", "!==", "&&", "||", "??", "**", "(", "TEMPLATE", "else", "catch", "finally") if x in k]
        nl = re.escape(k["NL"])
        esc = lambda xs: "[" + "".join(map(re.escape, xs)) + "]"
        self.drop = re.compile(rf"(?<!{esc(after)}){nl}+|{nl}+(?={esc(no)})|{nl}+$").sub
        self.squeeze = re.compile(rf"{nl}{nl}+").sub

    def kind(self, t: str) -> str:
        k = self.g.tokens
        if t[0] == "`" and len(t) > 1:
            return k["TEMPLATE"]
        if t[0] == "#" and len(t) > 1:
            return k["HASHBANG"] if t[1] == "!" else k["PRIVATE"]
        if t[-1:].isalpha() or t[-1] == "/":
            m = re.match(r"(return|typeof|case|in|of|=>|[(,=:\[!&|?{};+<>*%~^-])\s*(/(?![*/])[\s\S]+/[a-z]*)$", t)
            if m:
                return self[m.group(1)] + k["REGEX"]
        if t[0] in "0123456789" and t[-1] == "n" and t[:-1].isdigit():
            return k["NUM"]
        return super().kind(t)

    def tokens(self, text: str) -> str:
        nl = self.g.tokens["NL"]
        s = super().tokens(text)
        if self.bad in s and "${" in text:  # templates inside templates, deeper than the pattern above
            s = super().tokens(flat_script(text))
        return self.drop("", self.squeeze(nl, s))


class JavaLexer(Lexer):
    def __init__(self, grammar: Grammar):
        super().__init__(
            grammar,
            rf"\s+|{_C}|\"\"\"[ \t]*\n(?:[^\"\\]|\\[\s\S]|\"(?!\"\"))*\"\"\"|{_DQ}|'(?:[^'\\\n]|\\[^\n]{{1,6}}?)'|(?:{_NUM}[lLfFdD]?)(?![\w$])|[^\W\d]*[\w$]+|\.\.\.|<<=|->|::|==|!=|<=|<<|\+\+|--|&&|\|\||[+\-*/%&|^]=|[\s\S]",
        )

    def string(self, t: str) -> str:
        return self.g.tokens["CHAR" if t[0] == "'" else "STR"]


class GoLexer(Lexer):
    def __init__(self, grammar: Grammar):
        super().__init__(
            grammar,
            rf"\s+|{_C}|`[^`]*`|{_DQ}|'(?:[^'\\\n]|\\[^\n]{{1,9}}?)'|(?:{_NUM}i?)(?!\w)|{_WORD}|\.\.\.|&\^=|<<=|>>=|:=|<-|&\^|==|!=|<=|>=|<<|>>|\+\+|--|&&|\|\||[+\-*/%&|^]=|[\s\S]",
            "\n",
        )
        k = grammar.tokens
        ends = "".join(re.escape(k[x]) for x in ("NAME", "NUM", "STR", "CHAR", ")", "]", "}", "++", "--", "break", "continue", "fallthrough", "return"))
        self.semi = re.compile(rf"(?<=[{ends}])(?:\n+|$)").sub

    def string(self, t: str) -> str:
        return self.g.tokens["CHAR" if t[0] == "'" else "STR"]

    def tokens(self, text: str) -> str:
        s = self.semi(self.g.tokens[";"], super().tokens(text))
        return s.replace("\n", "")


class RustLexer(Lexer):
    def __init__(self, grammar: Grammar):
        raw = r"(?:[bc]?r\"[^\"]*\"|[bc]?r#\"[\s\S]*?\"#|[bc]?r##\"[\s\S]*?\"##)"
        super().__init__(
            grammar,
            rf"\s+|{_C}|{raw}|[bc]?\"(?:[^\"\\]|\\[\s\S])*\"|b?'(?:[^'\\\n]|\\[^\n]{{1,10}}?)'|'[^\W\d]\w*|(?:0x[0-9a-fA-F_]+|0b[01_]+|0o[0-7_]+|\d[\d_]*(?:\.\d[\d_]*|\.(?![.\w]))?(?:[eE][+-]?[\d_]+)?)(?:[iuf](?:8|16|32|64|128|size))?(?!\w)|r#{_WORD}|{_WORD}|#!(?!\[)[^\n]*|\.\.=|\.\.\.|<<=|::|->|=>|\.\.|==|!=|<=|<<|&&|\|\||[+\-*/%&|^]=|[\s\S]",
        )
        k = grammar.tokens
        self.k = k

    def tokens(self, text: str) -> str:
        return super().tokens(flat_rust(text))

    def kind(self, t: str) -> str:
        k = self.k
        if t[0] == "#" and t[:2] == "#!" and len(t) > 2:
            return k["HASHBANG"]
        if t[-1] == '"' and len(t) > 1 or (t[-1] == "#" and '"' in t):
            return k["STR"]
        if t[-1] == "'" and len(t) > 1:
            return k["CHAR"]
        if t[0] == "'" and len(t) > 1:
            return k["LIFETIME"]
        if t.startswith("r#"):
            return k["NAME"]
        return super().kind(t)


def _rust_grammar() -> Grammar:
    """Token trees hold any token but brackets, so the rule for them is made from all other rules."""
    tokens = sorted({t for t in re.findall(r"'([^']+)'", RUST) if t not in ("(", ")", "[", "]", "{", "}")} | {"$", "~"})
    every = " | ".join(["NAME", "NUM", "STR", "CHAR", "LIFETIME", *(f"'{t}'" for t in tokens)])
    return Grammar(RUST.replace("TREE", "anytoken") + f"anytoken = {every}\n", "file", {"stmt": ";"})


LANGUAGE_OF = {"py": "python", "rs": "rust", "js": "javascript", "ts": "typescript", "go": "go", "java": "java", "json": "json"}


@lru_cache(maxsize=None)
def tools(language: str) -> tuple[Lexer, Recogniser]:
    """The lexer and recogniser of a language, made once in each process."""
    sys_limit()
    if language == "python":
        g = Grammar(PYTHON, "file", {"simple3": "NL", "params3": ")", "params": ")"}, ("INDENT", "DEDENT"))
        return PythonLexer(g), Recogniser(g)
    if language in ("javascript", "typescript"):
        g = Grammar(JAVASCRIPT if language == "javascript" else TYPESCRIPT, "file", {"simple": ";", "params": ")", "args": ")"}, ("NL", "*"))
        return ScriptLexer(g), Recogniser(g)
    if language == "java":
        g = Grammar(JAVA, "file", {"stmt": ";", "params": ")"})
        return JavaLexer(g), Recogniser(g)
    if language == "go":
        g = Grammar(GO, "file", {"stmt": ";", "params": ")"})
        return GoLexer(g), Recogniser(g)
    if language == "rust":
        g = _rust_grammar()
        return RustLexer(g), Recogniser(g)
    g = Grammar(JSON, "file", {"pair": ","})
    return JsonLexer(g), Recogniser(g)


def sys_limit() -> None:
    import sys

    sys.setrecursionlimit(max(sys.getrecursionlimit(), 6000))


def valid(text: str, language: str) -> bool:
    """Whether some dialect of the language accepts the text; a file without tokens is valid except in JSON and Go."""
    lexer, recogniser = tools(language)
    tokens = lexer.tokens(text)
    return NEVER not in tokens and recogniser.accepts(tokens)
